"""Exact greedy packing of ordered rows into groups, parallel inside one key.

Greedy packing is sequential: where a group ends decides where the next one starts.
But the only thing one block of rows needs from everything before it is the size of the
group still open at its edge, and a block's reaction to that size is a short step
function.  So every block is summarised independently, the summaries are chained in
order (one small row per block), and every block is then packed independently with its
known starting size.  No key is ever confined to one task, whatever its share of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 10_000


def _breaks(cost, extra, force, limit):
    """For a group opened at each row: where the next group opens, in one backward sweep."""
    n = len(cost)
    total = np.concatenate([[0], np.cumsum(cost)])
    forced = np.append(np.where(force, np.arange(n), n), n)
    next_forced = np.minimum.accumulate(forced[::-1])[::-1]
    # The row after which extra + sum(p..j) first exceeds the limit opens the next group.
    over = np.searchsorted(total, total[:-1] - extra + limit, side="right") - 1
    return np.minimum(np.maximum(over, np.arange(n) + 1), np.minimum(next_forced[1:], n)), total


def _flags(frame: pd.DataFrame):
    alone = frame["__alone"].to_numpy(dtype=bool)
    force = frame["__force"].to_numpy(dtype=bool) | alone
    force[1:] |= alone[:-1]
    return frame["__cost"].to_numpy(dtype=np.int64), frame["__extra"].to_numpy(dtype=np.int64), force, alone


def _summarise(limit: int, keys: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__order", kind="stable")
        cost, extra, force, alone = _flags(frame)
        n = len(cost)
        nxt, total = _breaks(cost, extra, force, limit)
        edge, opened = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        closed = limit + 1 if alone[-1] else None
        for p in range(n - 1, -1, -1):
            if nxt[p] >= n:
                edge[p] = closed if closed is not None else extra[p] + total[n] - total[p]
                opened[p] = 1
            else:
                edge[p], opened[p] = edge[nxt[p]], opened[nxt[p]] + 1
        # First break for an open size u: the first row with u + sum(0..j) > limit, or a forced one.
        stops = np.nonzero((total[1:] > limit) | force)[0]
        last = int(stops[0]) if len(stops) else n - 1
        at = np.arange(last + 1)
        threshold = limit - total[1 : last + 2]
        if len(stops) and force[last]:
            threshold[-1] = -1
        return pd.DataFrame(
            [
                (
                    *[frame[k].iat[0] for k in keys], frame["__block"].iat[0], threshold.tolist(), edge[at].tolist(),
                    opened[at].tolist(), int(total[n]),
                )
            ],
            columns=[*keys, "__block", "threshold", "edge", "opened", "total"],
        )

    return run


def _chain(limit: int, keys: list[str]):
    """Carry (open size, groups so far) over the ordered block summaries of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, size, groups = None, 0, 0
        for frame in batches:
            sizes, counts = [], []
            for row in frame.itertuples(index=False):
                key = tuple(row[: len(keys)])
                if key != current:
                    current, size, groups = key, limit + 1, 0
                sizes.append(size)
                counts.append(groups)
                threshold, edge, opened, total = row[-4:]
                hit = np.nonzero(size > np.asarray(threshold))[0]
                if len(hit):
                    size, groups = int(edge[hit[0]]), groups + int(opened[hit[0]])
                else:
                    size += int(total)
            out = frame[[*keys, "__block"]].copy()
            out["__size"], out["__groups"] = sizes, counts
            yield out

    return run


def _pack(limit: int, keys: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__order", kind="stable")
        cost, extra, force, alone = _flags(frame)
        size, group = int(frame["__size"].iat[0]), int(frame["__groups"].iat[0]) - 1
        out = []
        for c, e, f, a in zip(cost, extra, force, alone):
            if f or size + c > limit:
                group, size = group + 1, e + c
            else:
                size += c
            if a:
                size = limit + 1
            out.append(group)
        result = frame[[*keys, "__order"]].copy()
        result["group_no"] = out
        return result

    return run


def greedy_groups(
    df: DataFrame,
    keys: list[str],
    order: str,
    cost: Column,
    limit: int,
    *,
    extra: Column | None = None,
    force: Column | None = None,
    alone: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Adds `group_no` (0, 1, … per key) by greedy packing in `order` (a long column).

    A row joins the open group unless it is forced, stands alone, or would push the
    group's cost over the limit; `extra` is charged once to the row opening a group.
    """
    names = {k: df.schema[k].dataType.simpleString() for k in keys}
    columns = ", ".join(f"`{k}` {t}" for k, t in names.items())
    no = F.lit(False)
    slim = df.select(
        *keys,
        F.col(order).cast("long").alias("__order"),
        F.floor(F.col(order) / F.lit(block)).cast("long").alias("__block"),
        cost.cast("long").alias("__cost"),
        (extra if extra is not None else F.lit(0)).cast("long").alias("__extra"),
        F.coalesce(force if force is not None else no, no).alias("__force"),
        F.coalesce(alone if alone is not None else no, no).alias("__alone"),
    )
    grouped = slim.groupBy(*keys, "__block")
    summaries = grouped.applyInPandas(
        _summarise(limit, keys),
        f"{columns}, __block long, threshold array<long>, edge array<long>, opened array<long>, total long",
    )
    chained = (
        summaries.repartition(*keys).sortWithinPartitions(*keys, "__block")
        .mapInPandas(_chain(limit, keys), f"{columns}, __block long, __size long, __groups long")
    )
    packed = (
        slim.join(chained, [*keys, "__block"]).groupBy(*keys, "__block")
        .applyInPandas(_pack(limit, keys), f"{columns}, __order long, group_no long")
    )
    return df.join(packed.withColumnRenamed("__order", order), [*keys, order])
