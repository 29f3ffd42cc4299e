"""Days that lie apart: of each key's days the first, and each that lies `apart` days or more after the last one taken.

What is taken next depends only on what was taken last, so a day points to its successor, the first day at least
`apart` later, and the days taken are those on the path from the first.  A key's days are cut into slices of bounded
length, so that one key is worked on by many tasks:

1. In each slice, a pass from its end finds for its first days where the path that enters there leaves the slice.  As
   days differ, a path enters a slice within its first `apart` rows, so few rows are kept of each.
2. Among those rows pointers are doubled, one join a round, until the paths from each key's first day are known: the round
   that doubles 2^k slices marks what lies 2^k slices on.
3. Each slice is walked once from where the path enters it.

Keys of one slice, however many, need the third pass only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import slices
from tessera.sources.state import cut


def _successors(d: np.ndarray, apart: int) -> np.ndarray:
    return np.searchsorted(d, d + max(1, apart))


def _exits(p: pd.DataFrame) -> pd.DataFrame:
    """For the rows of a slice at which a path may enter: where it leaves."""
    p = p.sort_values("loc", ignore_index=True)
    loc, apart, own = p["loc"].to_numpy(), int(p["apart"].iloc[0]), int(p["__own"].sum())
    after = _successors(p["d"].to_numpy(), apart)
    leaves = np.full(own, -1, np.int64)
    for k in range(own - 1, -1, -1):
        to = after[k]
        leaves[k] = leaves[to] if to < own else loc[to] if to < len(loc) else -1
    entries = slice(0, min(own, max(1, apart)))
    out = pd.DataFrame({"loc": loc[entries], "to": leaves[entries]})
    out.insert(0, "symbol", [p["symbol"].iloc[0]] * len(out))
    return out[out["to"] >= 0]


def _walk(p: pd.DataFrame) -> pd.DataFrame:
    """The rows of a slice on the path that enters it."""
    p = p.sort_values("loc", ignore_index=True)
    after = _successors(p["d"].to_numpy(), int(p["apart"].iloc[0]))
    k, taken = int(p["entry"].iloc[0] - p["loc"].iloc[0]), []
    while k < len(p):
        taken.append(k)
        k = after[k]
    return p.iloc[taken][["symbol", "d"]]


def _entries(placed: DataFrame, rows: int, n_slices: int) -> DataFrame:
    """symbol, __slice, entry: where each key's path enters each slice that it meets."""
    furthest = max(1, int(placed.agg(F.max("apart")).first()[0]))
    kind = placed.schema["symbol"].dataType.simpleString()
    edges = slices.with_halos(placed, 0, furthest, rows).groupBy("symbol", "__slice").applyInPandas(_exits, f"symbol {kind}, loc long, to long")
    jump = cut(edges)
    jumps = [jump]
    while 2 ** len(jumps) < n_slices:
        onward = jump.select("symbol", F.col("loc").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.join(onward, ["symbol", "to"]).select("symbol", "loc", F.col("further").alias("to")))
        jumps.append(jump)
    on_path = placed.where("loc = 0").select("symbol", "loc")
    for j in reversed(jumps):
        on_path = cut(on_path.unionByName(on_path.join(j, ["symbol", "loc"]).select("symbol", F.col("to").alias("loc"))))
    return on_path.select("symbol", F.floor(F.col("loc") / rows).alias("__slice"), F.col("loc").alias("entry"))


def spaced(days: DataFrame, keys: list[str], apart: Column | int, rows: int = slices.ROWS) -> DataFrame:
    """keys, d: the days taken of each key.  days: keys and d (a date); apart: days, the same for all rows of a key.

    Repeated days count once, a null day is none, a null key is a key of its own.
    """
    named = F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)])
    distance = F.lit(apart) if isinstance(apart, int) else apart
    plain = days.where(F.col("d").isNotNull()).groupBy(named.alias("symbol"), F.unix_date("d").cast("long").alias("d")).agg(F.max(distance).cast("int").alias("apart"))
    placed = cut(slices.located(plain, rows))
    longest = placed.agg(F.max("n_rows")).first()[0] or 0
    sliced = placed.withColumn("__slice", F.floor(F.col("loc") / rows))
    n_slices = -(-longest // rows)
    entered = sliced.withColumn("entry", F.lit(0).cast("long")) if n_slices <= 1 else sliced.join(_entries(placed, rows, n_slices), ["symbol", "__slice"])
    kind = placed.schema["symbol"].dataType.simpleString()
    taken = entered.groupBy("symbol", "__slice").applyInPandas(_walk, f"symbol {kind}, d long")
    return taken.select(*[F.col(f"symbol.k{n}").alias(k) for n, k in enumerate(keys)], F.date_from_unix_date(F.col("d").cast("int")).alias("d"))
