"""Levelled compaction over a manifest (file_id, level, mn, mx, n, bytes, newest). Plans are computed from
one manifest version and hold no state."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TOMBSTONE, Options
from . import runs

#: Jobs of a plan that a task makes, and bytes of them that it sends at a time.
VICTIMS_A_TASK, PLAN_BYTES = 250, 4 << 20


def level_target(opt: Options, level: Column) -> Column:
    """Linear in the level."""
    return opt.level0_bytes * level


def triggers(manifest: DataFrame, opt: Options) -> DataFrame:
    """(level, files, due): level 0 by the number of files, others by their nominal size; both strict."""
    per = manifest.groupBy("level").agg(F.count("*").alias("files"))
    due = F.when(F.col("level") == 0, F.col("files") > opt.level0_files).otherwise(F.col("files") * opt.file_bytes > level_target(opt, F.col("level")))
    return per.withColumn("due", due)


class Files:
    """Files in the order of mn (ids and ends as numbers), to be asked which of them a range meets, ends included."""

    def __init__(self, ids: np.ndarray, mn: np.ndarray, mx: np.ndarray):
        order = np.argsort(mn, kind="stable")
        self.ids, self.mn, self.mx = ids[order], mn[order], mx[order]
        self.reach, self.ends = np.maximum.accumulate(self.mx), np.sort(mx)

    def meeting(self, mn: int, mx: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.reach, mn, side="left"), np.searchsorted(self.mn, mx, side="right")
        return self.ids[lo:hi][self.mx[lo:hi] >= mn]

    def met(self, mn: np.ndarray, mx: np.ndarray) -> np.ndarray:
        """How many files each of the ranges meets: those that start up to its end, less those that end before it."""
        return np.searchsorted(self.mn, mx, side="right") - np.searchsorted(self.ends, mn, side="left")


class Manifest:
    """A manifest on the driver: files in the order of their names, ends of ranges as ranks, and the files of each
    level. Victims (the files of due levels) are their numbers, lowest level first."""

    def __init__(self, manifest: DataFrame, opt: Options):
        held = runs.rows_of(manifest.select("file_id", "level", "mn", "mx"))
        held = held.take(pa.array(sorted(range(held.num_rows), key=held["file_id"].to_pylist().__getitem__), pa.int64()))
        self.names, self.levels = held["file_id"].to_pylist(), held["level"].to_numpy().astype(np.int64)
        self.kind = dict(manifest.dtypes)["level"]
        ((self.mn, self.mx),) = runs.ranked(held)
        self.of = {int(x): Files(at, self.mn[at], self.mx[at]) for x in np.unique(self.levels) for at in [np.flatnonzero(self.levels == x)]}
        due = triggers(manifest.sparkSession.createDataFrame(held.select(["level"])), opt).where("due").select("level").collect()
        due = sorted(r["level"] for r in due if r["level"] < opt.levels - 1)
        self.victims = np.concatenate([np.empty(0, np.int64), *(np.flatnonzero(self.levels == x) for x in due)])

    def inputs(self, victim: int) -> np.ndarray:
        """The other files of a victim's job, in the order of their names."""
        level, none = int(self.levels[victim]), np.empty(0, np.int64)
        found = [self.of[x].meeting(self.mn[victim], self.mx[victim]) if x in self.of else none for x in ((0, 1) if level == 0 else (level + 1,))]
        found = np.sort(np.concatenate(found))
        return found[found != victim]

    def job(self, victim: int) -> tuple:
        level, inputs = int(self.levels[victim]), self.inputs(victim)
        return self.names[victim], level, level + 1, ",".join(map(self.names.__getitem__, inputs.tolist())), level > 0 and not len(inputs)


def plan(manifest: DataFrame, opt: Options) -> DataFrame:
    """(job, victim, start_level, end_level, inputs, trivial): one job per file of a due level; inputs are the
    files of the next level, and for level 0 of level 0 itself, that overlap it. Lowest level first. A job
    without other inputs below level 0 is a move in the manifest. The tasks have the manifest and make a share of
    the jobs each, so a job is never pieced together from pairs."""
    spark, known = manifest.sparkSession, Manifest(manifest, opt)
    sent = spark.sparkContext.broadcast(known)
    columns = ["victim", "start_level", "end_level", "inputs", "trivial"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for rows in batches:
            for victim in rows["at"].tolist():
                out.append(sent.value.job(victim))
                size += len(out[-1][3]) + 100
                if size > PLAN_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
        yield pd.DataFrame(out, columns=columns)

    at = spark.createDataFrame(pa.table({"at": known.victims})).repartition(1 + len(known.victims) // VICTIMS_A_TASK)
    return at.mapInPandas(run, f"victim string, start_level {known.kind}, end_level {known.kind}, inputs string, trivial boolean")


def moves(manifest: DataFrame, opt: Options) -> DataFrame:
    """(victim, end_level) of the trivial jobs of the plan: the files are counted that a victim meets, not listed."""
    known = Manifest(manifest, opt)
    alone = [np.empty(0, np.int64)]
    for level in np.unique(known.levels[known.victims]).tolist():
        at = known.victims[known.levels[known.victims] == level]
        if level > 0:
            alone.append(at[known.of[level + 1].met(known.mn[at], known.mx[at]) == 0] if level + 1 in known.of else at)
    rows = [(known.names[x], int(known.levels[x]) + 1) for x in np.concatenate(alone).tolist()]
    return manifest.sparkSession.createDataFrame(rows, f"victim string, end_level {known.kind}")


def touching(files: list[dict]) -> list[list[dict]]:
    """Manifest rows in groups, in key order: ranges of different groups share no key (ends included)."""
    out: list[list[dict]] = []
    end = None
    for f in sorted(files, key=lambda f: (f["mn"], f["mx"])):
        if end is None or f["mn"] > end:
            out.append([])
            end = f["mx"]
        out[-1].append(f)
        end = max(end, f["mx"])
    return out


def jobs(manifest: DataFrame, opt: Options) -> DataFrame:
    """The jobs of the plan that can run together, with their place in the queue: lowest level first, then by
    victim; at most one of level 0, and none that has a file of one before it. What a job would take is counted by
    the ends of the files taken on its levels; only the jobs that are chosen list their files, each file once."""
    known, out, zero = Manifest(manifest, opt), [], False
    taken = np.zeros(len(known.names), bool)
    starts, ends = ({x: [] for x in range(opt.levels + 1)} for _ in range(2))
    for victim in known.victims.tolist():
        level, mn, mx = int(known.levels[victim]), int(known.mn[victim]), int(known.mx[victim])
        met = any(bisect_right(starts[x], mx) > bisect_left(ends[x], mn) for x in ((0, 1) if level == 0 else (level + 1,)))
        if taken[victim] or met or (zero and level == 0):
            continue
        zero = zero or level == 0
        for x in (victim, *known.inputs(victim).tolist()):
            taken[x] = True
            insort(starts[int(known.levels[x])], int(known.mn[x]))
            insort(ends[int(known.levels[x])], int(known.mx[x]))
        out.append((len(out), *known.job(victim)))
    return manifest.sparkSession.createDataFrame(out, "place long, victim string, start_level long, end_level long, inputs string, trivial boolean")


def merge(rows: DataFrame, bottom: bool) -> DataFrame:
    """Merges files (k, v, seq, newest of the file): the version in the newest file wins, of one file the
    greatest seq. Deletions go only where no deeper level can hold the key."""
    out = rows.groupBy("k").agg(F.max(F.struct("newest", "seq", "v")).alias("n")).select("k", "n.seq", "n.v")
    return out.where(F.col("v") != TOMBSTONE) if bottom else out


def split(merged: DataFrame, by: list[str], opt: Options) -> DataFrame:
    """merged (with z) and file_no, block_no within the file: a record opens a block if that would reach the
    block size; each block counts in full towards its file, which rolls before the record that would reach
    the file's size."""
    schema = T.StructType([*merged.schema.fields, T.StructField("file_no", T.LongType()), T.StructField("block_no", T.LongType())])
    block, limit = opt.block_bytes, opt.file_bytes

    def cut(z: np.ndarray, state: list[int], files: np.ndarray, blocks: np.ndarray) -> None:
        """One group's sizes, block by block: a block ends by a search in the running sums."""
        used, tracked, file_no, block_no = state
        total, at = np.concatenate([[0], np.cumsum(z)]), 0
        while at < len(z):
            end = int(np.searchsorted(total[at + 1 :] - total[at], block - used, side="left")) + at  # opens the next block
            rolls = np.flatnonzero(z[at:end] >= limit - tracked)
            stop = at + int(rolls[0]) if len(rolls) else end
            files[at:stop], blocks[at:stop] = file_no, block_no
            used += int(total[stop] - total[at])
            if stop == len(z):
                break
            if stop == end:
                used, tracked, block_no = 2, tracked + block, block_no + 1
            if tracked + z[stop] >= limit:
                used, tracked, file_no, block_no = 2, block, file_no + 1, 0
            files[stop], blocks[stop] = file_no, block_no
            used, at = used + int(z[stop]), stop + 1
        state[:] = used, tracked, file_no, block_no

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, []
        for rows in batches:
            if not len(rows):
                continue
            keys = rows[by].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
            files, blocks, z = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), rows["z"].to_numpy(np.int64)
            for lo, hi in zip(edges, edges[1:]):
                if tuple(keys[lo]) != last:
                    last, state = tuple(keys[lo]), [2, block, 0, 0]
                cut(z[lo:hi], state, files[lo:hi], blocks[lo:hi])
            yield rows.assign(file_no=files, block_no=blocks)

    return merged.repartition(*by).sortWithinPartitions(*by, "k").mapInPandas(run, schema)


def move(manifest: DataFrame, moves: DataFrame) -> DataFrame:
    """The manifest after the moves: levels change, no file is rewritten."""
    moved = moves.select(F.col("victim").alias("file_id"), "end_level")
    return manifest.join(moved, "file_id", "left").withColumn("level", F.coalesce("end_level", "level")).drop("end_level")


def amplification(flushed: DataFrame, log: DataFrame) -> DataFrame:
    """Versions stored against live keys, and bytes written to files against bytes put."""
    stored = flushed.agg(F.count("*").alias("stored"), F.sum("z").alias("file_bytes"))
    kept = log.groupBy("k").agg(F.max(F.struct("seq", "v")).alias("n")).where(F.col("n.v") != TOMBSTONE).agg(F.count("*").alias("live"))
    put = log.agg(F.sum(F.octet_length("k") + F.octet_length("v") + 4).alias("log_bytes"))
    return stored.crossJoin(kept).crossJoin(put)  # one row each
