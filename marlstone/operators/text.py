"""Headline sentiment by a finance lexicon, and its daily aggregate."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of single words (fixed values).
WORD_WEIGHTS: dict[str, float] = {
    "beat": +0.22, "beats": +0.22, "exceeded": +0.18, "exceeds": +0.18, "outperformed": +0.16, "outperform": +0.14, "upgraded": +0.22,
    "upgrade": +0.18, "buyback": +0.14, "dividend": +0.10, "acquisition": +0.08, "merger": +0.08, "record": +0.10, "breakout": +0.12,
    "expansion": +0.10, "miss": -0.22, "misses": -0.22, "missed": -0.22, "downgraded": -0.22, "downgrade": -0.18, "underperform": -0.14,
    "underperformed": -0.16, "layoffs": -0.16, "layoff": -0.16, "bankruptcy": -0.32, "bankrupt": -0.28, "default": -0.22, "fraud": -0.26,
    "investigation": -0.14, "probe": -0.12, "recall": -0.14, "restatement": -0.18, "restate": -0.16, "restated": -0.16, "suspended": -0.14,
    "delisted": -0.20, "delist": -0.20, "writedown": -0.16, "impairment": -0.14, "settlement": -0.10, "regulatory": -0.08, "subpoena": -0.20,
    "sec": -0.08,
}

#: Weights of phrases (fixed values).
PHRASE_WEIGHTS: dict[str, float] = {
    "guidance raise": +0.22, "raised guidance": +0.22, "raised its guidance": +0.22, "raised outlook": +0.18, "raised forecast": +0.18,
    "beat estimates": +0.24, "beat expectations": +0.24, "top estimates": +0.18, "record quarter": +0.20, "record revenue": +0.18,
    "share buyback": +0.16, "stock buyback": +0.16, "debt free": +0.12, "guidance cut": -0.24, "cut guidance": -0.24, "cut its guidance": -0.24,
    "cut outlook": -0.20, "missed estimates": -0.26, "missed expectations": -0.26, "below estimates": -0.22, "profit warning": -0.24,
    "earnings miss": -0.26, "revenue miss": -0.24, "chapter 11": -0.35, "class action": -0.22, "criminal charges": -0.28, "going concern": -0.24,
}

#: What is stripped from both ends of a word (fixed values).
PUNCTUATION = ".,!?:;()\"'—–"


def _weights(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lexicon_boost(text: Column, words: dict[str, float] = WORD_WEIGHTS, phrases: dict[str, float] = PHRASE_WEIGHTS, most: float = 0.5) -> Column:
    """Sum of the weights of all words and of the phrases that occur, within +-``most``; null and blank text: 0."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # only words of the table leave the regular expression, so no array of all words is made
    edge, table = f"[{re.escape(PUNCTUATION)}]*", _weights(words)
    known = F.regexp_extract_all(low, F.lit(rf"(?:^|\s){edge}({'|'.join(map(re.escape, words))}){edge}(?=\s|$)"), F.lit(1))
    total = F.aggregate(known, F.lit(0.0), lambda a, w: a + F.element_at(table, w))
    for phrase, weight in phrases.items():
        total = total + F.when(F.contains(low, F.lit(phrase)), weight).otherwise(0.0)
    return F.greatest(F.least(total, F.lit(most)), F.lit(-most))


def scored_headlines(news: DataFrame, title: str = "title", base: Column | None = None) -> DataFrame:
    """Adds boost, sentiment (general score + 0.35 boost, within +-1, four digits) and label.

    ``base`` is a general-purpose score in [-1, 1] that the caller supplies;
    without one it is 0.
    """
    general = F.lit(0.0) if base is None else base
    blank = F.trim(F.coalesce(F.col(title), F.lit(""))) == ""
    score = F.when(blank, 0.0).otherwise(F.round(F.greatest(F.least(general + 0.35 * F.col("_boost"), F.lit(1.0)), F.lit(-1.0)), 4))
    label = F.when(F.col("sentiment") >= 0.05, "positive").when(F.col("sentiment") <= -0.05, "negative").otherwise("neutral")
    once = news.withColumn("_boost", lexicon_boost(F.col(title)))
    return once.withColumn("boost", F.round("_boost", 4)).withColumn("sentiment", score).withColumn("label", label).drop("_boost")


def sentiment_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: counts, mean, extremes, dispersion and the composite score from 0 to 100."""
    s, n = F.col("sentiment"), F.count("*")
    positive = F.count_if(F.col("label") == "positive")
    spread = F.coalesce(F.stddev_pop(s), F.lit(0.0))
    composite = (F.avg(s) + 1) / 2 * 100 * 0.45 + positive / n * 100 * 0.25 + F.least(n / 20, F.lit(1.0)) * 100 * 0.20 + F.greatest(1 - spread * 2, F.lit(0.0)) * 100 * 0.10
    return scored.groupBy(*by).agg(
        n.alias("article_count"),
        F.round(F.avg(s), 4).alias("avg_sentiment"),
        positive.alias("positive_count"),
        F.count_if(F.col("label") == "negative").alias("negative_count"),
        F.count_if(F.col("label") == "neutral").alias("neutral_count"),
        F.round(F.max(s), 4).alias("max_sentiment"),
        F.round(F.min(s), 4).alias("min_sentiment"),
        F.round(positive / n, 4).alias("positive_ratio"),
        F.round(composite, 4).alias("sentiment_score"),
        F.round(spread, 4).alias("score_dispersion"),
    )


def backfilled(summary: DataFrame, universe: DataFrame, key: str, neutral: float = 50.0) -> DataFrame:
    """Every symbol of the universe; those without articles get the neutral score and zero counts."""
    return universe.select(key).join(summary, key, "left").withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(neutral))).withColumn("article_count", F.coalesce("article_count", F.lit(0)))
