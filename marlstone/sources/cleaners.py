"""Rows of market feeds, as texts under the feeds' own column names, as typed rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalars import safe_float, safe_int

_FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def flattened(df: DataFrame, separator: str = "|") -> DataFrame:
    """Columns named by their price field, in lower case with underscores: of names with several levels, the first level that knows a price field gives them."""
    levels = [c.split(separator) for c in df.columns]
    plain = lambda name: re.sub(r"\s+", "_", name.strip().lower())
    depth = max((len(x) for x in levels), default=1)
    picked = next((i for i in range(depth) if any(len(x) > i and plain(x[i]) in _FIELDS for x in levels)), -1)
    return df.toDF(*[plain(x[picked] if -len(x) <= picked < len(x) else x[-1]) for x in levels])


def _value(df: DataFrame, *names: str) -> Column:
    have = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None)).cast("string")


def _dated(df: DataFrame, names: Sequence[str] = ("date", "cob_date", "index")) -> Column:
    return F.try_to_timestamp(F.substring(_value(df, *names), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def clean_prices(raw: DataFrame, symbol: Column, currency: Column) -> DataFrame:
    """Prices with a date: what isn't a finite number is null, volume is whole and not negative (else the row goes), high and low are put the right way round."""
    df = flattened(raw)
    out = df.select(
        symbol.alias("symbol"), _dated(df).alias("cob_date"), *[safe_float(_value(df, c)).alias(f"{c}_price") for c in ("open", "high", "low", "close")],
        safe_float(_value(df, "adj_close", "adjclose")).alias("adj_close_price"), safe_int(_value(df, "volume")).alias("volume"), currency.alias("currency"),
    )
    good = out.filter("cob_date IS NOT NULL AND symbol IS NOT NULL AND (volume IS NULL OR volume >= 0)")
    wrong = F.coalesce(F.col("high_price") < F.col("low_price"), F.lit(False))
    return good.withColumns({"high_price": F.when(wrong, F.col("low_price")).otherwise(F.col("high_price")), "low_price": F.when(wrong, F.col("high_price")).otherwise(F.col("low_price"))})


def clean_fx(raw: DataFrame, pair: Column) -> DataFrame:
    """Rates of days that have a close; a row without one is a failed download."""
    df = flattened(raw)
    out = df.select(pair.alias("currency_pair"), _dated(df).alias("cob_date"), *[safe_float(_value(df, c)).alias(f"{c}_rate") for c in ("open", "high", "low", "close")])
    return out.filter("cob_date IS NOT NULL AND close_rate IS NOT NULL")


def clean_index(raw: DataFrame) -> DataFrame:
    """An index's days, all prices as they are; volume may be 0."""
    df = flattened(raw)
    prices = [safe_float(_value(df, c)).alias(f"{c}_price") for c in ("open", "high", "low", "close", "adj_close")]
    return df.select(_dated(df).alias("cob_date"), *prices, safe_int(_value(df, "volume")).alias("volume")).filter("cob_date IS NOT NULL")


def clean_esg(raw: DataFrame) -> DataFrame:
    """Scores whose total is a number: symbol, cob_date, total and pillars."""
    names = {"total_esg": ("total_esg", "totalesg"), "environment_score": ("environment_score", "environmentscore"), "social_score": ("social_score", "socialscore"), "governance_score": ("governance_score", "governancescore"), "peer_percentile": ("peer_percentile", "percentile")}
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    out = df.select(F.trim(_value(df, "symbol")).alias("symbol"), _dated(df).alias("cob_date"), *[safe_float(_value(df, *n)).alias(c) for c, n in names.items()])
    return out.filter("total_esg IS NOT NULL AND symbol IS NOT NULL")


def has_valid_close(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether each group (or all of it) has a close that is a number."""
    close = safe_float(_value(df, "close"))
    return df.groupBy(*by).agg((F.count(close) > 0).alias("valid"))


# Symbols in providers' spellings (suffix tables are fixed values).

_SWISS = (".SW", ".ZU", ".S")
_REPORT_SUFFIX = {".L": ".LON", ".PA": ".PAR", ".DE": ".DEU", ".AS": ".AMS", ".TO": ".TRT", ".SW": ".SWX", ".MI": ".MIL", ".MC": ".MCE"}


def with_exchange(symbol: Column, suffix: str = ".O") -> Column:
    """A symbol without a dot gets one."""
    s = F.trim(symbol)
    return F.when(s.contains("."), s).otherwise(F.concat(s, F.lit(suffix)))


def swiss_candidates(symbol: Column) -> Column:
    """Spellings to try in order: three for Swiss symbols, else the symbol."""
    s = F.trim(symbol)
    base = F.regexp_replace(s, r"(?i)\.(SW|S)$", "")
    return F.when(F.upper(s).rlike(r"\.(SW|S)$"), F.array(*[F.concat(base, F.lit(x)) for x in _SWISS])).otherwise(F.array(s))


def suffix_mapped(symbol: Column, table: dict[str, str] = _REPORT_SUFFIX) -> Column:
    """The exchange suffix in another provider's spelling; unknown ones stay."""
    s = F.trim(symbol)
    own = F.regexp_extract(s, r"(\.[^.]*)$", 1)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when((own != "") & F.map_contains_key(known, own), F.concat(F.substring(s, F.lit(1), F.char_length(s) - F.char_length(own)), F.try_element_at(known, own))).otherwise(s)


def filer_ids(raw: DataFrame, text: str = "value", digits: int = 10) -> DataFrame:
    """(symbol, filer_id) of a JSON dictionary of {cik_str, ticker, title}: upper-case tickers, ids padded with zeros; of repeated tickers the first by id."""
    rows = F.explode(F.map_values(F.from_json(text, "map<string, struct<cik_str: long, ticker: string>>")))
    pairs = raw.select(rows.alias("r")).filter("r.ticker IS NOT NULL AND r.cik_str IS NOT NULL")
    return pairs.groupBy(F.upper(F.trim("r.ticker")).alias("symbol")).agg(F.lpad(F.min("r.cik_str").cast("string"), digits, "0").alias("filer_id"))
