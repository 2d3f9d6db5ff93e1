"""Operator 4: packing documents into sequences by minimum bin slack.

Lengths are whole numbers up to the capacity, so all that the packing needs of the corpus is one
count per length, however large the corpus. plan() fills bin after bin: a bitset subset-sum over
the lengths still there finds the fullest bin that holds the longest piece left, and that
combination is taken as often as the counts allow. It yields a few thousand slots at most, a bound
that depends on the capacity alone; they are broadcast, and each piece finds its slot by its length
and its rank among the pieces of that length. Ranks come from counts per (length, hash of the id),
so one length that a third of all pieces share is many groups.

Defined results: null or empty text is the end id alone; only documents over the capacity are cut,
into whole sequences, the first piece taking the remainder; repeated rows are packed each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, release, ship, stored, text_of
from .tokens import Ids, default_path, made

CAPACITY, END_ID = 1024, 2


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""
    ship(docs.sparkSession)
    path = path or default_path()
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = made(Ids, path)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = memoryview(coder.encode(x.as_py()) + end)
                n, start, k = len(ids) // 4, 0, 0
                while start < n:
                    length = n if n <= capacity else (n % capacity or capacity) if k == 0 else capacity
                    for o, v in zip(out, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        o.append(v)
                    start, k = start + length, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types)], names=names)
        release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of lengths {length: times} with the largest sum up to capacity that holds the
    longest length there is; of equal sums one with longer pieces."""
    first = max(counts)
    room, goal = capacity - first, None
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # what was reachable before, length, times
    for length in sorted((x for x in counts if x <= room), reverse=True):
        have, times = min(counts[length] - (length == first), room // length), 1
        while have > 0:
            times = min(times, have)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & mask
            have, times = have - times, times * 2
            if reach >> room:
                goal = room
                break
        if goal is not None:
            break
    at = reach.bit_length() - 1
    out = {first: 1}
    for was, length, times in reversed(steps):
        if not was >> at & 1:  # needed to get here
            at -= length * times
            out[length] = out.get(length, 0) + times
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): the pieces of that length with those ranks
    go to that many sequences from the first on, one each, all at the offset."""
    left, used, slots, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        combo = fullest(left, capacity)
        times = min(left[x] // k for x, k in combo.items())
        offset = 0
        for length in sorted(combo, reverse=True):
            for _ in range(combo[length]):
                slots.append((length, used[length], times, sequence, offset))
                used[length] += times
                offset += length
            left[length] -= times * combo[length]
            if not left[length]:
                del left[length]
        sequence += times
    return slots


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """pieces() with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, capacity, end_id), "pack-pieces").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(8 * parts(spark))))
    groups = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("before", before)
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan(counts, capacity), "s_length long, s_rank long, s_n long, s_seq long, s_offset long")
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("own", own).join(groups.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    # few slots a length and a bounded table: a broadcast join on the length, kept where the rank falls in
    lists = slots.groupBy("s_length").agg(F.array_sort(F.collect_list(F.struct("s_rank", "s_n", "s_seq", "s_offset"))).alias("slots"))
    ranked = ranked.join(F.broadcast(lists), F.col("length") == F.col("s_length"))
    slot = F.element_at(F.filter("slots", lambda x: (x["s_rank"] <= F.col("rank")) & (F.col("rank") < x["s_rank"] + x["s_n"])), 1)
    ranked = ranked.withColumn("slot", slot)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.s_seq") + F.col("rank") - F.col("slot.s_rank")).alias("sequence_id"), F.col("slot.s_offset").alias("offset"))
