"""Greedy packing: a running size that starts anew when the next record doesn't fit.

That is not a window function, for each restart depends on the one before. It runs per group (a
shard, a run, a key range) over rows sorted within the partition, batch by batch, with only the
current size held; groups run in parallel. Within a batch the next restart is found by a binary
search in the running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """A group restarts when size + record + extra reaches the cap (or only exceeds it, if strict)."""

    cap: int
    start: int = 0
    strict: bool = False
    extra: int = 0

    def restarts(self, sizes: np.ndarray, held: int) -> tuple[np.ndarray, int]:
        """Of consecutive records, which ones restart; held: size before them, -1 for none yet."""
        out = np.zeros(len(sizes), bool)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        if held < 0:
            held, at = self.start + int(sizes[0]), 1
        while at < len(sizes):
            # the first record whose running size is too much
            room = self.cap - self.extra - held
            side = "right" if self.strict else "left"
            end = int(np.searchsorted(total[at + 1 :] - total[at], room, side=side)) + at
            if end >= len(sizes):
                held += int(total[-1] - total[at])
                break
            out[end] = True
            held, at = self.start + int(sizes[end]), end + 1
        return out, held


def fold(df: DataFrame, group: list[str], order: list[str], size: str, rule: Rule, out: str, dealt: bool = False) -> DataFrame:
    """df with `out`, the number of restarts in the row's group up to it. dealt: df was repartitioned by
    group and has only been aggregated or folded since, so that each group is in one partition."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, number = None, -1, 0
        for rows in batches:
            if not len(rows):
                continue
            keys = list(map(tuple, rows[group].itertuples(index=False))) if group else [()] * len(rows)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            found = np.empty(len(rows), np.int64)
            sizes = rows[size].to_numpy(np.int64)
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != last:
                    last, held, number = keys[lo], -1, 0
                hits, held = rule.restarts(sizes[lo:hi], held)
                found[lo:hi] = number + np.cumsum(hits)
                number = int(found[hi - 1])
            yield rows.assign(**{out: found})

    if not dealt:
        df = df.repartition(*group) if group else df.coalesce(1)
    return df.sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def fold_sql(rows: str, rule: Rule, out: str) -> str:
    """CTEs s and f for rows (a query of grp, rn, z): f has grp, rn and the group's number as `out`."""
    op = ">" if rule.strict else ">="
    over = f"f.acc + s.z + {rule.extra} {op} {rule.cap}"
    return f"""s AS MATERIALIZED ({rows}), f AS (
      SELECT grp, rn, 0::BIGINT AS {out}, (z + {rule.start})::BIGINT AS acc FROM s WHERE rn = 1 UNION ALL
      SELECT s.grp, s.rn, CASE WHEN {over} THEN f.{out} + 1 ELSE f.{out} END, CASE WHEN {over} THEN {rule.start} + s.z ELSE f.acc + s.z END
      FROM f JOIN s ON s.grp = f.grp AND s.rn = f.rn + 1)"""
