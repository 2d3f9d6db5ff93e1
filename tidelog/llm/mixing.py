"""Operator 6: mixing sources to target weights by the cube method.

Each source gets a target in words; a document of it is taken floor(f) times and once more with
probability f - floor(f), f = target / size of the source. Which ones are taken once more is balanced
sampling: the vector of probabilities moves through the null-space of the constraints (words and
documents taken of the source) until it meets the cube's walls. That flight runs in blocks of at
most about BLOCK documents, which keep both totals; the at most two undecided documents of each
block fly again together, until one block a source is left. There LANDING documents, the longest, are
kept for the landing. The flight keeps every document's probability. The landing doesn't: it takes
the corner of the cube with the least error in words, then in documents, which makes each source's
total as exact as its documents allow. A source of any size is thus many small groups, and nothing
gathers at the driver.

Defined results: null text has size 0; null source is a source, last in order; documents of size 0
are never taken in words but keep their place in the copies (floor(f) + the draw); a text of any
length is one document; repeated rows are rows of their own, and of rows equal in doc_id, source and
text it is open which gets which draw; doc_id may be null or repeat, in one source or in several; an
empty table gives an empty result; other columns, whatever their names, are not read. Draws depend on
doc_id, source, text and SEED alone, so reruns agree; ties between equal hashes are between equal rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BUDGET, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, LANDING, SEED, NEAR = 1000, 12, 17, 1e-9
#: A group of equal rows is numbered in so many parts.
PARTS = 64


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, content, size, draw): content tells rows of one doc_id and source apart, draw is
    what chance depends on."""
    rows = docs.select(docs["doc_id"], docs["source"], F.xxhash64(text_of(docs)).alias("content"), F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"))
    return rows.withColumn("draw", F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "content"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, target), one row a source. Sharing the excess again and again ends
    at target = min(most * size, level * weight); the level comes from running sums over the sources in
    order of most * size / weight, where they stop one after another."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return per.select("source", "n_docs", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _direction(size: list[float]) -> tuple[float, float, float]:
    """Of three documents, a vector that changes neither their number nor their words."""
    a, b, c = size
    u = (c - b, a - c, b - a)
    return u if any(u) else (1.0, -1.0, 0.0)


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves prob until at most two of its elements lie between 0 and 1; both totals stay."""
    p, size = prob.tolist(), size.astype(float).tolist()
    draws, open_, at = rng.random(len(p) + 3).tolist(), [], 0
    k = 0
    while True:
        while len(open_) < 3 and at < len(p):
            if NEAR < p[at] < 1 - NEAR:
                open_.append(at)
            at += 1
        if len(open_) < 3:
            break
        u = _direction([size[i] for i in open_])
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(open_, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(open_, u) if x)
        t = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for i, x in zip(open_, u):
            p[i] = min(1.0, max(0.0, p[i] + t * x))
            p[i] = 0.0 if p[i] <= NEAR else 1.0 if p[i] >= 1 - NEAR else p[i]
        open_ = [i for i in open_ if 0 < p[i] < 1]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the few open elements to the corner with the least error in words, then in documents."""
    open_ = np.flatnonzero((prob > 0) & (prob < 1))
    corners = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = corners - prob[open_]
    best = np.lexsort((np.abs(off.sum(axis=1)), np.abs(off @ size[open_])))[0]
    out = prob.copy()
    out[open_] = corners[best]
    return np.rint(out)


def _block(last: bool):
    """Arrow tables in and out: ids stay whole numbers beside nulls."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        draw, size = rows["draw"].to_numpy(), rows["size"].to_numpy().astype(float)
        order = np.lexsort((draw, size) if last else (size, draw))
        rows, draw, size = rows.take(pa.array(order)), draw[order], size[order]
        prob = rows["prob"].to_numpy().copy()
        fly = len(prob) - LANDING if last else len(prob)
        if fly > 0:
            seed = [SEED, rows["round"][0].as_py(), *(int(x) % (1 << 63) for x in draw[:2])]
            prob[:fly] = flight(prob[:fly], size[:fly], np.random.default_rng(seed))
        return rows.set_column(rows.schema.get_field_index("prob"), "prob", pa.array(land(prob, size) if last else prob, pa.float64()))

    return run


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, source, content, size, source_size, target, whole, copies (whole or
    one more), taken = size * copies."""
    spark = docs.sparkSession
    ship(spark)
    sizes = stored(sized(docs), "mix-sizes")
    goals = stored(targets(sizes, weights, budget, most), "mix-targets")
    # one row a source; it is broadcast only where it is small, which Spark checks on the stored table
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(f + NEAR)
    goals = goals.withColumns({"whole": whole, "prob": F.greatest(F.lit(0.0), f - whole)})
    g = goals.withColumnRenamed("source", "__source")
    rows = sizes.join(g, sizes["source"].eqNullSafe(g["__source"]), "left").drop("__source")
    flat = ["doc_id", "source", "content", "size", "draw", "source_size", "target", "whole", "prob", "round", "n_docs"]
    rows = rows.withColumn("round", F.lit(0)).select(*flat)
    done, most_docs = [], goals.agg(F.max("n_docs")).first()[0] or 0
    while True:
        last = most_docs <= block
        blocks = F.ceil(F.col("n_docs") / block)
        cell = F.pmod(F.xxhash64("draw", "round"), F.greatest(blocks, F.lit(1))) if not last else F.lit(0)
        moved = rows.groupBy("source", cell.cast("long").alias("cell")).applyInArrow(_block(last), rows.schema)
        moved = stored(moved, "mix-flight")
        if last:
            done.append(moved)
            break
        settled = (F.col("prob") <= 0) | (F.col("prob") >= 1)
        done.append(moved.where(settled))
        left = moved.where(~settled)
        counts = left.groupBy("source").agg(F.count("*").alias("__n"))
        most_docs = counts.agg(F.max("__n")).first()[0] or 0
        counts = counts.withColumnRenamed("source", "__source")
        left = left.join(counts, left["source"].eqNullSafe(counts["__source"]))
        rows = left.withColumn("n_docs", F.col("__n")).withColumn("round", F.col("round") + 1).select(*flat)
    out = reduce(DataFrame.union, done).withColumn("copies", (F.col("whole") + F.round("prob")).cast("long"))
    return out.select("doc_id", "source", "content", "size", "source_size", "target", "whole", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns as they were.

    A row is known by doc_id, source and the hash of its text, so texts cross one exchange at most, that
    of the join. Rows equal in all three are interchangeable: so many of them are taken once more, and
    only these are numbered, each group in PARTS parts."""
    key = ["__id", "__source", "__content"]
    got = mix(docs, weights, budget, most)
    got = got.groupBy(*(F.col(c).alias(k) for c, k in zip(("doc_id", "source", "content"), key))).agg(F.count("*").alias("__n"), F.max("whole").alias("__whole"), F.sum(F.col("copies") - F.col("whole")).alias("__more"))
    got = stored(got, "mix-copies")
    own = docs.withColumn("__own", F.xxhash64(text_of(docs)))

    def at(one: DataFrame, other: DataFrame) -> Column:
        return one["doc_id"].eqNullSafe(other["__id"]) & one["source"].eqNullSafe(other["__source"]) & (one["__own"] == other["__content"])

    def taken(rows: DataFrame, copies: Column) -> DataFrame:
        rows = rows.withColumn("__copies", copies.cast("int")).where("__copies > 0")
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)

    more = F.col("__whole") + F.col("__more")
    once = got.where((F.col("__n") == 1) & (more > 0))
    out = taken(own.join(once, at(own, once)), more)
    again = got.where("__n > 1")
    if again.isEmpty():
        return out
    rows = stored(own.join(again, at(own, again)).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "mix-again")
    cell = Window.partitionBy(*key, "__part")
    before = rows.groupBy(*key, "__part").agg(F.count("*").alias("__held"))
    before = before.withColumn("__before", F.sum("__held").over(Window.partitionBy(*key).orderBy("__part")) - F.col("__held")).drop("__held")
    before = before.select(*(F.col(c).alias(f"{c}2") for c in [*key, "__part"]), "__before")
    rows = rows.withColumn("__row", F.row_number().over(cell.orderBy("__own")))
    met = rows.join(before, reduce(Column.__and__, [rows[c].eqNullSafe(before[f"{c}2"]) for c in [*key, "__part"]]))
    return out.union(taken(met, F.col("__whole") + (F.col("__row") + F.col("__before") <= F.col("__more")).cast("int")))
