"""Pairs of labels that fire together, from bitmaps.

A label's firings on a symbol are bits of 64-bit words, one a day, and 64 words make a block (some eleven years).  How often
two labels fire together is the number of bits in the conjunctions of their words, so labels meet once a symbol and block
and not once a firing.  Labels meet in tiles: each is dealt to one of TILES groups, and a tile holds those of one
group as the first and of another as the second of a pair, so one block of many labels is worked on by TILES^2 tasks' keys.
A firing counts once, however often it is listed; null labels, symbols or days are none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.state import cut

DAYS, WORDS, TILES = 64, 64, 8


def bitmaps(hits: DataFrame) -> DataFrame:
    """label, symbol, block, words (an array of longs) of firings: label, symbol, d."""
    day = F.unix_date(F.to_date("d"))
    word = F.floor(day / DAYS)
    bits = hits.dropna(subset=["label", "symbol", "d"]).groupBy("label", "symbol", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(DAYS)))).alias("bits"))
    placed = bits.groupBy("label", "symbol", F.floor(F.col("word") / WORDS).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(WORDS)).cast("int"), "bits"))).alias("at"))
    return placed.select("label", "symbol", "block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.col("at")[k], F.lit(0).cast("long"))).alias("words"))


def _count(word: Callable[[int], Column]) -> Column:
    """Bits of the words, written out: lambdas over arrays would be interpreted for each pair."""
    return reduce(lambda a, b: a + b, [F.bit_count(word(k)) for k in range(WORDS)]).cast("long")


def _met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Each row of left (a) with each of right (b) of a greater label and equal `on`, tile by tile."""
    group = lambda name: F.pmod(F.xxhash64(name), F.lit(TILES))
    every = F.explode(F.sequence(F.lit(0), F.lit(TILES - 1)))
    first = left.withColumn("tile_b", every).withColumn("tile_a", group("a").cast("int"))
    second = right.withColumn("tile_a", every).withColumn("tile_b", group("b").cast("int"))
    return first.join(second, [*on, "tile_a", "tile_b"]).where("a < b").drop("tile_a", "tile_b")


def pairs(hits: DataFrame, all_pairs: bool = False) -> DataFrame:
    """a, b, both, n_a, n_b: of each pair of labels (a < b) that fire together their common firings and each one's own.

    all_pairs: also those that never do, at 0.
    """
    maps = cut(bitmaps(hits))  # read three times, and small beside the firings
    n = maps.groupBy("label").agg(F.sum(_count(lambda k: F.get("words", F.lit(k)))).alias("n"))
    of = lambda name: maps.select(F.col("label").alias(name), "symbol", "block", F.col("words").alias(f"words_{name}"))
    common = _count(lambda k: F.get("words_a", F.lit(k)).bitwiseAND(F.get("words_b", F.lit(k))))
    both = _met(of("a"), of("b"), "symbol", "block").groupBy("a", "b").agg(F.sum(common).alias("both")).where("both > 0")
    own = lambda name: n.select(F.col("label").alias(name), F.col("n").alias(f"n_{name}"))
    if all_pairs:
        return _met(own("a"), own("b")).join(both, ["a", "b"], "left").fillna(0, ["both"]).select("a", "b", "both", "n_a", "n_b")
    return both.join(own("a"), "a").join(own("b"), "b").select("a", "b", "both", "n_a", "n_b")


def jaccard(hits: DataFrame, all_pairs: bool = False) -> DataFrame:
    """a, b, both, jaccard of each pair of labels."""
    return pairs(hits, all_pairs).select("a", "b", "both", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))
