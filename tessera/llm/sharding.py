"""Shards by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, and every shard has a weight; a node weighs what lies below it.  A
document descends from the root: on each level it makes a weighted draw for each child of the node that
it stands at, and goes to the child with the least, so racks and shards are drawn for in the chosen
region and rack alone.  A draw is an exponential variate with the child's weight as its rate, from a hash
of the document's key and the child's path; so a child is chosen in proportion to its weight.

A changed weight changes one draw a level, those of its shard and of what holds it.  Documents whose choice
on a level is not for or against that child stay where they are: movement is confined to subtrees whose
weights change.  One shard more (`Tree.grown`) opens a region of its own, which changes no other node's
weight, so it takes documents only into itself.

All of it is DataFrame expressions; there is no Python on the executors.  The tree is a literal array, so the
plan's size does not depend on the count of shards.

Defined results
    null text       size 8, checksum of no bytes
    empty text      the same
    very long text  read once, for its size and checksum; it never leaves the task that reads it
    null doc_id     drawn for like an id of its own
    repeated rows   the same shard; slots stay distinct
    equal draws     the child that comes first
    empty table     empty result
    extra columns   ignored
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Rows of one shard that are numbered together.
SLOT_ROWS = 100_000


@dataclass(frozen=True)
class Tree:
    """(region, rack, weights of its shards) in order; shards are numbered through in that order, regions stand together."""

    racks: tuple[tuple[int, int, tuple[float, ...]], ...]

    @staticmethod
    def even(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4) -> Tree:
        """Equal weights; shards fill rack after rack and region after region."""
        racks = [(k // racks_per_region, k, (1.0,) * min(shards_per_rack, shards - k * shards_per_rack)) for k in range(-(-shards // shards_per_rack))]
        return Tree(tuple(racks))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one shard more, in a rack and region of its own; the others keep their paths and weights."""
        region, rack = (max((r[k] for r in self.racks), default=-1) + 1 for k in (0, 1))
        return Tree((*self.racks, (region, rack, (weight,))))

    def shards(self) -> int:
        return sum(len(w) for *_, w in self.racks)


def nodes(tree: Tree) -> Column:
    """The tree as nested arrays of (path, weight, children); a shard has its number instead of children."""
    shard, regions = 0, []
    for region, racks in groupby(tree.racks, key=lambda r: r[0]):
        below, total = [], 0.0
        for _, rack, weights in racks:
            leaves = [F.struct(F.lit(f"{region}/{rack}/{k}").alias("path"), F.lit(float(w)).alias("weight"), F.lit(shard + k).alias("shard")) for k, w in enumerate(weights)]
            below.append(F.struct(F.lit(f"{region}/{rack}").alias("path"), F.lit(float(sum(weights))).alias("weight"), F.array(*leaves).alias("below")))
            shard, total = shard + len(weights), total + sum(weights)
        regions.append(F.struct(F.lit(str(region)).alias("path"), F.lit(float(total)).alias("weight"), F.array(*below).alias("below")))
    return F.array(*regions)


def draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential variate of that rate, from 52 bits of an MD5; infinite where the weight is not positive."""
    value = F.conv(F.substring(F.md5(F.concat_ws("/", key, path)), 1, 13), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((value + 0.5) / float(2**52)) / weight).otherwise(float("inf"))


def chosen(children: Column, key: Column) -> Column:
    """The child with the least draw, the first of equals."""
    drawn = F.transform(children, lambda c, i: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), i.alias("i")))
    return F.element_at(children, F.array_min(drawn)["i"] + 1)


def descend(df: DataFrame, key: Column, tree: Tree, into: str) -> DataFrame:
    """df with the column `into`: the shard that the key descends to, by region, rack and shard."""
    steps = df.withColumn("__region", chosen(nodes(tree), key))
    steps = steps.withColumn("__rack", chosen(F.col("__region.below"), key))
    return steps.withColumn(into, chosen(F.col("__rack.below"), key)["shard"].cast("int")).drop("__region", "__rack")


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("none"))


def assign(df: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot of every row.

    size is the text's bytes and 8; slot numbers a shard's rows gapless from 0.  Rows of a shard are
    numbered in parts of about SLOT_ROWS by a hash of the id; the parts' counts come from the id column
    alone, and the text never leaves the task that reads it.
    """
    docs = common.id_and_text(df)
    parts = max(1, -(-df.count() // (SLOT_ROWS * tree.shards())))
    placed = descend(docs.withColumn("part", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(parts)).cast("int")), key_of(), tree, "shard")
    in_order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before"))
    rows = placed.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard", "part")
    rows = descend(rows, key_of(), grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("nth", F.row_number().over(own)).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - 1 + F.col("before")).alias("slot"), "grown_shard")
