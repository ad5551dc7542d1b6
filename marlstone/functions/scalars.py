"""Column expressions: tolerant casts, symbols and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency by exchange suffix (fixed values); a symbol without one trades in US dollars.
CURRENCY_BY_SUFFIX = {".L": "GBP", ".PA": "EUR", ".DE": "EUR", ".MC": "EUR", ".AS": "EUR", ".MI": "EUR", ".TO": "CAD", ".S": "CHF", ".SW": "CHF"}


def safe_float(value: Column) -> Column:
    """A finite double, or null for text that isn't one, NaN and infinities."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def safe_int(value: Column) -> Column:
    """``safe_float`` truncated to a long."""
    return safe_float(value).cast("long")


def rate(value: Column) -> Column:
    """A published rate: a dot stands for a missing day."""
    return safe_float(F.nullif(F.trim(value), F.lit(".")))


def exchange_suffix(symbol: Column) -> Column:
    return F.regexp_extract(F.trim(symbol), r"(\.[^.]*)$", 1)


def infer_currency(symbol: Column, default: str = "USD", table: dict[str, str] = CURRENCY_BY_SUFFIX) -> Column:
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(names, exchange_suffix(symbol)), F.lit(default))


def fx_pair(currency: Column) -> Column:
    """The pair that converts into US dollars; null for the dollar."""
    return F.when(currency != "USD", F.concat(currency, F.lit("USD=X")))


def remap_swiss(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"\.S$", ".SW")


def remap_share_class(symbol: Column, table: dict[str, str] = CURRENCY_BY_SUFFIX) -> Column:
    """A dot that names no exchange separates a share class, which the feed writes with a dash."""
    suffix = exchange_suffix(symbol)
    return F.when((suffix == "") | suffix.isin(*table), symbol).otherwise(F.replace(symbol, F.lit("."), F.lit("-")))


def feed_symbol(raw: Column) -> Column:
    """(symbol, feed_symbol, currency) of a raw ticker."""
    symbol = F.trim(raw)
    return F.struct(symbol.alias("symbol"), remap_share_class(remap_swiss(symbol)).alias("feed_symbol"), infer_currency(symbol).alias("currency"))


def is_us(symbol: Column) -> Column:
    return ~F.contains(symbol, F.lit("."))


def company_core(name: Column) -> Column:
    """A company's name up to the comma or legal form."""
    for end in (",", " Inc", " Corp", " Ltd", " plc", " SE", " SA", " AG", " NV"):
        name = F.substring_index(name, end, 1)
    return F.trim(name)


def guarded_ratio(top: Column, bottom: Column, most: float = 1e15, digits: int = 6) -> Column:
    """top / bottom rounded; null where it is undefined or not below ``most``."""
    ratio = F.try_divide(top, bottom)
    return F.when(F.abs(ratio) < most, F.round(ratio, digits))


def guarded_corr(x: str | Column, y: str | Column, least: float = 1e-12) -> Column:
    """Pearson correlation of the pairs without nulls; null where one side is (almost) constant. An aggregate."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    across = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.stddev_pop(x) > least) & (F.stddev_pop(y) > least), F.try_divide(F.covar_pop(x, y), across))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def clipped(value: Column, low: Column, high: Column) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
