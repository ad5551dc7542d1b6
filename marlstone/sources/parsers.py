"""Records of statement, news and factor feeds, read from files with Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.scalars import safe_float
from marlstone.operators.relational import first_per_key


def static_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """A company list whose columns may go by several names: the first alias with text wins; all trimmed."""
    raw = spark.read.csv(path, header=True)
    have = {c.strip().lower(): c for c in raw.columns}

    def pick(names: list[str]) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{have[n]}`")), F.lit("")) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = raw.select(*[pick(names).alias(name) for name, names in aliases.items()])
    return out.withColumn("country", F.substring("country", 1, 3)) if "country" in aliases else out


def factor_csv(lines: DataFrame, columns: list[str], text: str = "value") -> DataFrame:
    """A ragged monthly factor file: rows that begin with yyyyMM, dated at month end, percent to decimal."""
    rows = lines.filter(F.col(text).rlike(r"^\s*\d{6}\s*,"))
    parts = F.split(text, ",")
    month = F.last_day(F.to_date(F.concat(F.trim(parts[0]), F.lit("01")), "yyyyMMdd"))
    return rows.select(month.alias("date"), *[(safe_float(F.trim(F.get(parts, F.lit(i)))) / 100).alias(c) for i, c in enumerate(columns, 1)])


def compact_statement(raw: DataFrame) -> DataFrame:
    """A columns/data matrix as one map per row: symbol, row."""
    rows = F.explode(F.transform("data", lambda r: F.map_from_arrays(F.col("columns"), r)))
    return raw.select("symbol", rows.alias("row"))


_FACT = T.StructType([T.StructField("end", T.StringType()), T.StructField("val", T.DoubleType()), T.StructField("form", T.StringType()), T.StructField("fp", T.StringType())])


def filing_facts(raw: DataFrame, concepts: list[tuple[str, str]]) -> DataFrame:
    """symbol, field_name, report_date, period_type, field_value of filing facts (symbol, concept, facts array).

    ``concepts`` maps concept to field in order of priority; the first that
    has a (field, date, period) wins. Annual are 10-K facts of a full year,
    quarterly those of 10-Q and the first three quarters.
    """
    ranks = F.create_map(*[F.lit(x) for i, (c, f) in enumerate(concepts) for x in (c, F.struct(F.lit(i).alias("priority"), F.lit(f).alias("field")))]) if concepts else None
    rows = raw.select("symbol", F.element_at(ranks, F.col("concept")).alias("to"), F.posexplode("facts").alias("pos", "fact")).filter("to is not null")
    period = F.when((F.col("fact.form") == "10-K") & (F.col("fact.fp") == "FY"), "annual").when((F.col("fact.form") == "10-Q") & F.col("fact.fp").isin("Q1", "Q2", "Q3"), "quarterly")
    flat = rows.select("symbol", F.col("to.field").alias("field_name"), F.to_date("fact.end").alias("report_date"), period.alias("period_type"), F.col("fact.val").alias("field_value"), F.col("to.priority").alias("_p"), F.col("pos").alias("_i"))
    return first_per_key(flat.filter("period_type is not null and field_value is not null"), ["symbol", "field_name", "report_date", "period_type"], ["_p", "_i"]).drop("_p", "_i")


def news_feed(raw: DataFrame, text: str = "value") -> DataFrame:
    """Articles of two layouts, nested under ``content`` or flat with epoch seconds: title, source, published."""
    schema = "title string, publisher string, providerPublishTime bigint, content struct<title: string, pubDate: string, displayTime: string, provider: struct<displayName: string>>"
    a = F.from_json(text, schema)
    published = F.coalesce(F.try_to_timestamp(a["content"]["pubDate"]), F.try_to_timestamp(a["content"]["displayTime"]), F.timestamp_seconds(a["providerPublishTime"]))
    out = raw.select("*", F.coalesce(a["content"]["title"], a["title"]).alias("title"), F.coalesce(a["content"]["provider"]["displayName"], a["publisher"]).alias("publisher"), published.alias("published"))
    return out.filter(F.trim(F.coalesce("title", F.lit(""))).isin("", "[Removed]") == F.lit(False))


def info_ratios(raw: DataFrame, fields: dict[str, str], key: str = "symbol", info: str = "info") -> DataFrame:
    """A map of snapshot fields as rows: key, field_name, field_value; what isn't a finite number is left out."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field_name"), safe_float(F.element_at(info, F.lit(given))).alias("field_value")) for given, name in fields.items()])
    return raw.select(key, F.explode(pairs).alias("p")).select(key, "p.*").filter("field_value is not null")


def event_articles(raw: DataFrame, text: str = "value") -> DataFrame:
    """Articles of an event feed ({title, seendate: 20240131T120000Z, domain, url, language, sourcecountry}): those in English or of no language, with a title."""
    a = F.from_json(text, "title string, seendate string, domain string, url string, language string, sourcecountry string")
    out = raw.withColumn("_a", a).filter(F.coalesce(F.lower("_a.language"), F.lit("")).isin("", "english") & (F.coalesce("_a.title", F.lit("")) != ""))
    seen = F.try_to_timestamp("_a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return out.select("*", F.col("_a.title").alias("title"), F.coalesce("_a.domain", F.lit("")).alias("publisher"), seen.alias("published"), F.coalesce("_a.url", F.lit("")).alias("link")).drop("_a")


def listed_articles(raw: DataFrame, text: str = "value") -> DataFrame:
    """Articles of a listing feed ({title, publishedAt, source: {name}, url}): those whose title isn't blank or removed."""
    a = F.from_json(text, "title string, publishedAt string, source struct<name: string>, url string")
    title = F.trim(F.coalesce(a["title"], F.lit("")))
    out = raw.withColumns({"_a": a, "title": title}).filter(~F.col("title").isin("", "[Removed]"))
    return out.select("*", F.coalesce("_a.source.name", F.lit("unknown")).alias("publisher"), F.try_to_timestamp("_a.publishedAt").alias("published"), F.coalesce("_a.url", F.lit("")).alias("link")).drop("_a")
