"""States before rows in order, by composition of maps.

Where a row takes a state to the next one by a map, and two maps make one again,
the states before all rows need no single pass: rows are composed within blocks,
blocks within larger ones, and what comes before a block is handed down to its
rows.  A task holds one block, or the blocks of one key at the top.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
WIDTH = 1024
Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]
Act = Callable[[np.ndarray | None, np.ndarray], np.ndarray | None]


def before(maps: DataFrame, keys: list[str], combine: Combine, act: Act, levels: int = 1, width: int = WIDTH) -> DataFrame:
    """(keys, place, state array<double>) for ``maps`` (keys, place long, map array<double>): the state before each row of its key.

    ``combine`` gives the map of two in turn, ``act`` the state after a map; the
    state before the first row is null, None to ``act``.  ``levels`` of blocks
    stand between the rows and the task of a key, which sees one row for each
    width**levels.  Keys are strings without nulls, places distinct.
    """
    named = maps.select(*keys, "place", "map", F.floor(F.col("place") / width).alias("block"))
    head = ", ".join(f"{k} string" for k in keys)

    def walk(rows: pd.DataFrame, state: np.ndarray | None) -> pd.DataFrame:
        rows, out = rows.sort_values("place"), []
        for m in rows["map"]:
            out.append(state)
            state = act(state, np.asarray(m))
        return rows[[*keys, "place"]].assign(state=out)

    if not levels:
        return named.groupBy(*keys).applyInPandas(lambda rows: walk(rows, None), f"{head}, place long, state array<double>")

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        return rows[keys].head(1).assign(place=rows["block"].head(1), map=[reduce(combine, map(np.asarray, rows["map"]))])

    blocks = named.groupBy(*keys, "block").applyInPandas(whole, f"{head}, place long, map array<double>")
    starts = before(blocks, keys, combine, act, levels - 1, width).select(*keys, F.col("place").alias("block"), "state")

    def inside(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        state = start["state"].iloc[0] if len(start) else None
        return walk(rows, state)

    return named.groupBy(*keys, "block").cogroup(starts.groupBy(*keys, "block")).applyInPandas(inside, f"{head}, place long, state array<double>")
