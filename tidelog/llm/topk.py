"""Operator 10: exact top-k search by columnar branch-and-bound.

Vectors are whole numbers, held as matrices of blocks with one dimension after the other. For a
block of queries against a block of candidates, inner products grow by DIMS dimensions at a time; what
the rest can still add is at most the product of the rests' norms. Pairs whose bound is below the
query's k-th best score so far leave: while many are left the candidates that some query still needs
are compacted, once few are left the pairs themselves. The k-th best scores start at those against
PILOT candidates, the same for every task, which is a bound that no result can be below; so cells need
nothing of each other.

Queries against all rows in blocks: a task holds CELL candidates and QUERIES queries as Arrow columns,
its result is k rows a query, and the lists of a query's cells are merged, each task's best first. A
vector crosses the network once per CELL rows or QUERIES queries that it meets.

Defined results: vectors null, empty, or with null or non-finite components take no part; so do rows
without vec_id; candidates of another dimension than the query don't count for it; vectors of any
length are read whole; a repeated vec_id is several candidates, none of them for its own query, and its
query is asked once for each; ties go to the smaller vec_id; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

K, EVERY, SCALE = 20, 20, 64
CELL, QUERIES, DIMS, PILOT = 8192, 4096, 16, 2048
#: Candidates and queries that one matrix product has; share of pairs from which on they are listed.
STEP, ROWS, SPARSE = 2048, 512, 0.05


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select("vec_id", "embedding").where(ok).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _rests(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of what follows each cut; a little more, for a bound mustn't lose a tie by rounding."""
    return np.sqrt(np.stack([(m[:, a:] ** 2).sum(axis=1) for a in cuts[1:]])) * (1 + 1e-9) + 1e-6


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, rows in order."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], scores[keep]


def floors(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k-th best score against c; minus infinity if there are fewer."""
    if len(c) < k:
        return np.full(len(q), -np.inf)
    scores = np.where(q_ids[:, None] == c_ids, -np.inf, q @ c.T)
    return np.partition(scores, len(c) - k, axis=1)[:, len(c) - k]


def search_block(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, dims: int = DIMS, least: np.ndarray | None = None, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of each query's k best candidates of a block, exactly; those below
    `least`, a score that k others reach, may be left out."""
    d = c.shape[1]
    cuts = [*range(0, d, dims), d]
    columns = [np.ascontiguousarray(c[:, a:b].T) for a, b in zip(cuts, cuts[1:])]  # one dimension after the other
    q_rest, c_rest = _rests(q, cuts), _rests(c, cuts)
    floor = np.full(len(q), -np.inf) if least is None else least.copy()
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for lo in range(0, len(c), step):
        at, part = np.arange(lo, min(len(c), lo + step)), q[:, : cuts[1]] @ columns[0][:, lo : lo + step]
        pairs = None
        for b in range(1, len(columns)):
            if pairs is None:
                alive = part + q_rest[b - 1][:, None] * c_rest[b - 1, at] >= floor[:, None]
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    i, j = np.nonzero(alive)
                    pairs, part = (i, at[j]), part[i, j]
                else:
                    need = alive.any(axis=0)
                    if not need.all():
                        at, part = at[need], part[:, need]
                    part = part + q[:, cuts[b] : cuts[b + 1]] @ columns[b][:, at]
                    continue
            i, j = pairs
            alive = part + q_rest[b - 1][i] * c_rest[b - 1][j] >= floor[i]
            i, j, part = i[alive], j[alive], part[alive]
            pairs, part = (i, j), part + np.einsum("pd,pd->p", q[i, cuts[b] : cuts[b + 1]], c[j, cuts[b] : cuts[b + 1]])
        if pairs is None:
            i, j = np.nonzero(part >= floor[:, None])
            pairs, part = (i, at[j]), part[i, j]
        i, j = pairs
        good = (part >= floor[i]) & (c_ids[j] != q_ids[i])
        if good.any():
            best = _best(np.concatenate([best[0], i[good]]), np.concatenate([best[1], c_ids[j[good]]]), np.concatenate([best[2], part[good]]), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
            last = np.searchsorted(best[0], full, side="right") - 1
            floor[full] = np.maximum(floor[full], best[2][last])
    return best[0], best[1], best[2].astype(np.int64)


def _matrices(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the vectors as a matrix, and which rows they are."""
    if not len(rows):
        return {}
    v = rows["v"].combine_chunks()
    size = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size).tolist():
        of = np.flatnonzero(size == d)
        held = v if len(of) == len(v) else v.take(pa.array(of))
        out[d] = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(of), d), of
    return out


def _cell(k: int, dims: int, pilot: tuple[np.ndarray, np.ndarray] | None):
    names = ["query_id", "query_row", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)] for _ in names]
        cands = _matrices(right)
        for d, (q, q_of) in _matrices(left).items():
            if d not in cands:
                continue
            c, c_of = cands[d]
            q_ids, q_rows = left["vec_id"].to_numpy()[q_of], left["row"].to_numpy()[q_of]
            c_ids = right["vec_id"].to_numpy()[c_of]
            for lo in range(0, len(q), ROWS):
                part, ids = q[lo : lo + ROWS], q_ids[lo : lo + ROWS]
                least = floors(part, pilot[0], ids, pilot[1], k) if pilot and pilot[0].shape[1] == d else None
                rows, found, score = search_block(part, c, ids, c_ids, k, dims, least)
                for o, x in zip(out, (ids[rows], q_rows[lo + rows], found, score)):
                    o.append(x)
        return pa.table([pa.array(np.concatenate(o), pa.int64()) for o in out], names=names)

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, cell: int = CELL, queries: int = QUERIES, dims: int = DIMS, pilot: int = PILOT) -> DataFrame:
    """query_id, rank, vec_id, score: each vec_id divisible by every, against all rows but its own."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(whole(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    asks = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asks.count()
    cells, blocks = max(1, -(-n // cell)), max(1, -(-m // queries))
    # `pilot` vectors at most, of the commonest dimension among them; they only give scores to start from
    held = rows.limit(pilot).select("vec_id", "v").toArrow()
    of = _matrices(held)
    known = max(((x, held["vec_id"].to_numpy()[at]) for x, at in of.values()), key=lambda x: len(x[1]), default=None)
    mine = F.pmod(F.xxhash64("row"), F.lit(cells))
    theirs = F.pmod(F.xxhash64("row"), F.lit(blocks))
    c = rows.withColumns({"c": mine, "q": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    q = asks.withColumns({"q": theirs.cast("int"), "c": F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))}).withColumn("c", F.col("c").cast("long"))
    found = q.groupBy("c", "q").cogroup(c.groupBy("c", "q")).applyInArrow(_cell(k, dims, known), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
