"""Finite automata over ordered rows.

A transition table maps state and class of symbol to the next state. What a run of symbols does is a map from the state
before it to the state behind it, and such maps compose, so a key's rows are mapped block by block, wherever these lie, and
only one map a block meets at the key: a key of any size spans tasks, and no window has to hold its rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def _table(table: list[list[int]]) -> Column:
    return F.array(*[F.array(*map(F.lit, row)) for row in table])


def block_maps(rows: DataFrame, key: list[str], pos: str, symbol: str, table: list[list[int]], block: int = BLOCK) -> DataFrame:
    """(*key, block, map): where each state leads over a block's symbols, in the order of ``pos`` (a long from 0, dense)."""
    own = rows.groupBy(*key, F.floor(F.col(pos) / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(symbol).alias("c")))).alias("_s"))
    start = F.array(*[F.lit(s) for s in range(len(table))])
    step = lambda acc, x: F.transform(acc, lambda s: _table(table)[s][x.c])
    return own.select(*key, "block", F.aggregate("_s", start, step).alias("map"))


def final_states(rows: DataFrame, key: list[str], pos: str, symbol: str, table: list[list[int]], start: int = 0, block: int = BLOCK) -> DataFrame:
    """(*key, state): the state that each key's symbols lead to from ``start``."""
    maps = block_maps(rows, key, pos, symbol, table, block).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("_m"))
    return maps.select(*key, F.aggregate("_m", F.lit(start), lambda s, x: x.map[s]).alias("state"))
