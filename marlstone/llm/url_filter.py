"""URL rules by host and path prefix, looked up in a cascade of Bloom filters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import ascii_lower, checkpointed, mixed

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at, found = F.coalesce(F.instr(F.col(url), "://"), F.lit(0)), _fresh(pages, "_rest")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    return (
        pages.withColumn(found, rest)
        .withColumn("host", ascii_lower(F.regexp_extract(found, r"\A[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract(found, r"\A[^/?#]*([^?#]*)", 1))
        .drop(found)
    )


def candidate_keys(host: Column, path: Column, lengths: list[int], labels: int) -> Column:
    """All keys by which a rule could fit: the host and its parent domains of at most ``labels`` labels, each with the path's prefixes of the rules' lengths."""
    every = F.split(host, r"\.")
    labels = F.when(F.size(every) > labels, F.slice(every, -labels, labels)).otherwise(every)
    hosts = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


class _Bloom:
    """One level: a bit array for keys given by two 64-bit hashes."""

    def __init__(self, pairs: np.ndarray, rate: float, level: int):
        self.level, self.k = level, max(1, round(-math.log2(rate)))
        self.m = max(64, math.ceil(len(pairs) * -math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)
        for at in self._places(pairs):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _places(self, pairs: np.ndarray):
        salt = np.uint64(self.level + 1)
        a, b = mixed(pairs[:, 0] + salt), mixed(pairs[:, 1] ^ salt) | np.uint64(1)
        for j in range(self.k):
            yield ((a + np.uint64(j) * b) % np.uint64(self.m)).astype(np.int64)

    def has(self, pairs: np.ndarray) -> np.ndarray:
        found = np.ones(len(pairs), bool)
        for at in self._places(pairs):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


class BloomCascade:
    """Exact membership for every key of a known universe.

    Level 1 encodes the listed keys, level 2 the unlisted keys that level 1
    takes for listed, level 3 the listed keys that level 2 takes for those,
    and so on until a level errs no more. The first level that rejects a key
    tells which side it is on.
    """

    def __init__(self, levels: list[_Bloom]):
        self.levels = levels

    def has(self, pairs: np.ndarray) -> np.ndarray:
        listed, left = np.zeros(len(pairs), bool), np.arange(len(pairs))
        for i, level in enumerate(self.levels):
            left = left[level.has(pairs[left])]
            listed[left] = i % 2 == 0
        return listed


def _pairs(a: pa.Array, b: pa.Array) -> np.ndarray:
    return np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (a, b)], axis=1)


def _member(cascade: BloomCascade):
    @F.arrow_udf("boolean")
    def member(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(cascade.has(_pairs(a, b)))

    return member


def build_cascade(listed: list[str], universe: DataFrame, max_keys: int, max_levels: int = 200) -> BloomCascade:
    """A cascade for ``listed`` over ``universe`` (one column ``key``, distinct).

    Level 1's error rate is set from the sizes of both sets, so that about as
    many unlisted keys pass it as keys are listed; it is lowered until at most
    ``max_keys`` do. Only those reach the driver, as two integers each.
    """
    spark = universe.sparkSession
    rows = spark.createDataFrame([(k,) for k in listed], "key string").select(*(h.alias(c) for h, c in zip(_hashes(F.col("key")), "ab"))).collect()
    ours = np.array([(r.a, r.b) for r in rows], np.int64).reshape(-1, 2).view(np.uint64)
    others = universe.filter(~F.col("key").isin(listed)) if len(listed) <= 1000 else universe.join(spark.createDataFrame([(k,) for k in listed], "key string"), "key", "left_anti")
    others = others.select(*(h.alias(c) for h, c in zip(_hashes(F.col("key")), "ab")))
    rate = min(0.5, max(1, len(ours)) / max(1, universe.count()))
    while True:
        levels = [_Bloom(ours, rate, 0)]
        passed = others.filter(_member(BloomCascade(levels))("a", "b")).limit(max_keys + 1).toArrow()
        if passed.num_rows <= max_keys:
            break
        rate /= 8
    sides = [ours, _pairs(passed["a"].combine_chunks(), passed["b"].combine_chunks())]
    while len(sides[len(levels) % 2]):
        if len(levels) == max_levels:
            raise ValueError("two keys share both hashes: no cascade can tell them apart")
        level = _Bloom(sides[len(levels) % 2], 0.5, len(levels))
        other = (len(levels) + 1) % 2
        sides[other] = sides[other][level.has(sides[other])]
        levels.append(level)
    return BloomCascade(levels)


def url_verdicts(pages: DataFrame, rules: list[UrlRule], default: str = ALLOW, max_keys: int = 1 << 22) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the
    rule's path; the longest fitting rule wins (of equally long ones, the
    first in string order). No rule: null ``rule`` and the ``default``
    verdict. The key universe is every candidate key of every row (parent
    domains with no more labels than a rule's host has, however many the host has), so
    membership is exact for each of them; the filters (about ``max_keys`` keys
    at most) are the only thing sent to all tasks. A longer rule list is
    joined by key instead. Every row is judged alone, repeated ones too. Null or odd urls have empty host and path and take
    the default; an empty table stays empty; of columns that the input already
    has under these four names, the new ones replace the old.
    """
    keyed = with_host_and_path(pages)
    verdict_of = {r.key: r.verdict for r in sorted(rules, key=lambda r: r.verdict)}
    lengths, labels = sorted({len(r.path) for r in rules}), max((r.host.count(".") + 1 for r in rules), default=1)
    if not rules:
        return keyed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keys, side, best = (_fresh(keyed, c) for c in ("_keys", "_sides", "_best"))
    keyed = keyed.withColumn(keys, candidate_keys(F.col("host"), F.col("path"), lengths, labels))
    if len(rules) > max_keys:
        return _by_join(keyed, verdict_of, default, keys, best)
    seen = with_host_and_path(pages.select("url")).select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct()
    universe = checkpointed(seen.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths, labels)).alias("key")).distinct())
    cascades = [build_cascade(sorted(k for k, v in verdict_of.items() if v == side), universe, max_keys) for side in (ALLOW, BLOCK)]

    @F.arrow_udf("array<tinyint>")
    def sides(a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = (x.fill_null([]) if x.null_count else x for x in (a, b))
        pairs = _pairs(a.flatten(), b.flatten())
        found = np.where(cascades[0].has(pairs), 1, np.where(cascades[1].has(pairs), 2, 0)).astype(np.int8)
        counts = np.r_[0, np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(counts), pa.array(found))

    a, b = F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1])
    hit = F.filter(F.arrays_zip(F.col(keys).alias("key"), F.col(side).alias("side")), lambda x: x["side"] > 0)
    first = F.array_min(F.transform(hit, lambda x: F.struct(-F.char_length(x["key"]), x["key"].alias("key"), x["side"].alias("side"))))
    out = keyed.withColumn(side, sides(a, b)).withColumn(best, first)
    verdict = F.when(F.col(f"{best}.side") == 1, ALLOW).when(F.col(f"{best}.side") == 2, BLOCK).otherwise(F.lit(default))
    return out.withColumn("rule", F.col(f"{best}.key")).withColumn("verdict", verdict).drop(keys, side, best)


def _by_join(keyed: DataFrame, verdict_of: dict[str, str], default: str, keys: str, best: str) -> DataFrame:
    spark = keyed.sparkSession
    listed = spark.createDataFrame(list(verdict_of.items()), "key string, verdict string")
    longest = F.max_by(F.struct("key", "verdict"), F.struct(F.char_length("key"), "key"))
    places = keyed.select("host", "path", F.explode(keys).alias("key")).distinct()
    found = places.join(listed, "key").groupBy("host", "path").agg(longest.alias(best))
    out = keyed.drop(keys).join(found, ["host", "path"], "left")
    return out.withColumn("rule", F.col(f"{best}.key")).withColumn("verdict", F.coalesce(f"{best}.verdict", F.lit(default))).drop(best)
