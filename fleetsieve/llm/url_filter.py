"""URL filters with a Bloom filter cascade: exact membership of every key of the corpus, no joins.

A url stands under the keys host suffix x path prefix, for every parent domain of its host and every
path length that a rule has. The keys of all urls are the universe. Level 1 of a cascade encodes the
listed keys; the keys of the universe that it takes wrongly are encoded by level 2; the listed keys
that level 2 takes are encoded by level 3, and so on until a level takes nothing wrongly. A key is
listed if the first level that denies it is an even one. There is one cascade for the allow rules and
one for the block rules; the longest key that either lists decides.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fleetsieve.llm.common import LOWER, UPPER
from fleetsieve.session import cut

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host(url: Column) -> Column:
    """Between the first :// and / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys under which a rule can fit, longest first: own host and parents, path prefixes of the lengths."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    made = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.struct(
        (-F.length(h) - F.length(p)).alias("size"), (-F.length(h)).alias("host_size"), F.concat(h, p).alias("key")))))
    return F.when(F.length(host) > 0, F.transform(F.array_sort(made), lambda x: x["key"])).otherwise(F.array().cast("array<string>"))


class Bloom:
    """Bits for the 64-bit hashes of keys; positions by double hashing."""

    def __init__(self, n, error, level):
        self.size = max(64, math.ceil(-n * math.log(error) / math.log(2) ** 2))
        self.hashes, self.level = max(1, round(self.size / max(1, n) * math.log(2))), level
        self.bits = np.zeros(self.size // 8 + 1, np.uint8)

    def places(self, h: np.ndarray) -> np.ndarray:
        mixed = (h ^ np.uint64(self.level)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        first, step = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32) | np.uint64(1)
        return ((first[:, None] + step[:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.size)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h)
        return (self.bits[at >> 3] >> (at & 7) & 1).all(axis=1)


def listed(levels: list[Bloom], h: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed, by the hashes of the keys."""
    out, open_ = np.zeros(len(h), bool), np.arange(len(h))
    for depth, level in enumerate(levels):
        taken = level.has(h[open_])
        out[open_[~taken]] = depth % 2 == 1
        open_ = open_[taken]
    out[open_] = len(levels) % 2 == 1
    return out


def _encode(spark, rows: DataFrame, n: int, error: float, level: int) -> Bloom:
    """A filter of the keys' hashes (h); tasks send distinct bytes of it, which are joined by bit_or."""
    bloom = Bloom(n, error, level)

    def places(batches):
        for b in batches:
            at = np.unique(bloom.places(b["h"].to_numpy(np.int64).view(np.uint64)))
            yield pd.DataFrame({"at": at >> 3, "bit": np.left_shift(1, at & 7)})

    found = rows.select("h").mapInPandas(places, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bloom.bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bloom


def cascade(universe: DataFrame, rules: DataFrame, error=0.01, last_error=0.5, depth=40) -> list[Bloom]:
    """Levels for the listed keys (rules: key) over all keys of the universe (key), both distinct.

    About ten bits a listed key at level 1 and few below. Keys are told apart by 64-bit hashes; keys of
    the universe that share the hash of a listed key would be found at level `depth`, which raises.
    """
    spark = universe.sparkSession
    inside = cut(rules.select(F.xxhash64("key").alias("h")).distinct())
    outside = cut(universe.select(F.xxhash64("key").alias("h")).join(inside, "h", "left_anti"))
    levels, now, other = [], inside, outside
    for level in range(depth):
        n = now.count()
        if n == 0:
            return levels
        bloom = _encode(spark, now, n, error if level == 0 else last_error, level + 1)
        levels.append(bloom)
        shared = spark.sparkContext.broadcast(bloom)  # its size follows from the number of keys

        def taken(batches, shared=shared):
            for b in batches:
                yield b[shared.value.has(b["h"].to_numpy(np.int64).view(np.uint64))]

        now, other = cut(other.mapInPandas(taken, "h bigint")), now
    raise RuntimeError("hashes of a listed and another key are equal")


def judge(pages: DataFrame, rules: list[tuple] = RULES, page_id="page_id", url="url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; urls that no rule fits are allowed.

    Null urls and urls without :// have empty host and path, no rule, and are allowed. Of rules that
    fit, the longest (host and path together) wins, then the one with the longer host.
    """
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, p, _ in rules})
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rows = rows.withColumn("keys", keys(F.col("host"), F.col("path"), lengths))
    universe = cut(rows.select(F.explode("keys").alias("key")).distinct())
    table = spark.createDataFrame([(h + p, v) for h, p, v in rules], "key string, verdict string")
    shared = spark.sparkContext.broadcast({v: cascade(universe, table.filter(F.col("verdict") == v).select("key")) for v in ("allow", "block")})

    @F.pandas_udf("array<int>")
    def verdicts(hashes: pd.Series) -> pd.Series:
        """Per key: 1 allowed, -1 blocked, 0 not listed."""
        sizes = hashes.map(len).to_numpy()
        h = np.concatenate([np.zeros(0, np.int64), *hashes]).astype(np.int64).view(np.uint64)
        found = listed(shared.value["allow"], h).astype(np.int32)
        found[listed(shared.value["block"], h)] = -1
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else [])

    judged = rows.withColumn("found", verdicts(F.transform("keys", lambda k: F.xxhash64(k))))
    hit = F.filter(F.arrays_zip("keys", "found"), lambda x: x["found"] != 0)
    return judged.withColumn("hit", F.get(hit, F.lit(0))).select(
        "page_id", "host", "path", F.col("hit.keys").alias("rule"), F.when(F.col("hit.found") < 0, "block").otherwise("allow").alias("verdict"))
