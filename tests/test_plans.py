"""Overlaps, plans, moves and jobs of manifests against plain Python, and what they cost."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.model import Options
from tidelog.operators import compaction, runs

OPT = Options(level0_files=2, file_bytes=1000, level0_bytes=1000, levels=4)


def manifest(spark, n, seed, width):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = rng.randrange(400)
        rows.append((f"{rng.randrange(10)}/{i}", rng.choice([0, 0, 1, 2, 3]), f"k{at:04d}", f"k{at + rng.choice([0, 0, rng.randrange(width)]):04d}"))
    return rows, spark.createDataFrame(rows, "file_id string, level long, mn string, mx string")


def jobs_of(rows):
    count = {x: sum(r[1] == x for r in rows) for x in range(4)}
    due = {x for x in range(3) if (count[0] > OPT.level0_files if x == 0 else count[x] * OPT.file_bytes > OPT.level0_bytes * x)}
    out = []
    for f, level, mn, mx in rows:
        if level in due:
            met = sorted(g for g, other, a, b in rows if g != f and a <= mx and mn <= b and (other == level + 1 or other == level == 0))
            out.append((f, level, level + 1, ",".join(met), level > 0 and not met))
    return out


CASES = [(0, 1, 5), (1, 2, 5), (40, 3, 3), (60, 4, 300), (200, 5, 20)]


@pytest.mark.parametrize("case", CASES[1:])
@pytest.mark.parametrize("closed", [True, False])
def test_overlaps(spark, case, closed):
    rows, df = manifest(spark, *case)
    some = df.where("level < 2")
    for a, b, of in ((df, df, rows), (some, df, [r for r in rows if r[1] < 2])):
        got = [(r["a_id"], r["b_id"]) for r in runs.overlaps(a, b, closed).collect()]
        assert sorted(got) == sorted((f, g) for f, _, x, y in of for g, _, z, w in rows if (x <= w and z <= y if closed else x < w and z < y))


def test_overlaps_make_no_other_rows(spark):
    """Files with ranges one in the other: a row a pair, not one for each end that a pair shares (1.1e9 here)."""
    n = 1500
    files = spark.createDataFrame([(str(i), f"{i:06d}", f"{2 * n - i:06d}") for i in range(n)], "file_id string, mn string, mx string")
    found = runs.overlaps(files, files, True)
    assert found.count() == n * n
    assert "slot" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("case", CASES)
def test_plan(spark, case, monkeypatch):
    monkeypatch.setattr(compaction, "PLAN_BYTES", 500)  # many small batches
    monkeypatch.setattr(compaction, "VICTIMS_A_TASK", 30)
    rows, df = manifest(spark, *case)
    found = compaction.plan(df, OPT)
    assert sorted(map(tuple, found.collect())) == sorted(jobs_of(rows))
    text = found._jdf.queryExecution().toString()
    assert "Join" not in text and "Aggregate" not in text  # jobs are not put together from pairs


@pytest.mark.parametrize("case", CASES)
def test_moves(spark, case):
    rows, df = manifest(spark, *case)
    got = compaction.move(df, compaction.moves(df, OPT)).select("file_id", "level").collect()
    to = {f: end for f, _, end, _, trivial in jobs_of(rows) if trivial}
    assert sorted(map(tuple, got)) == sorted((f, to.get(f, level)) for f, level, _, _ in rows)


@pytest.mark.parametrize("case", CASES)
def test_jobs(spark, case):
    rows, df = manifest(spark, *case)
    taken, want = set(), []
    for f, level, end, inputs, trivial in sorted(jobs_of(rows), key=lambda r: (r[1], r[0])):
        files = {f, *filter(None, inputs.split(","))}
        if not files & taken and not (level == 0 and want and want[0][2] == 0):
            taken |= files
            want.append((len(want), f, level, end, inputs, trivial))
    assert sorted(map(tuple, compaction.jobs(df, OPT).collect())) == want


def test_too_many_files(spark, monkeypatch):
    monkeypatch.setattr(runs, "MAX_FENCES", 20)
    files = spark.range(11).select(F.col("id").cast("string").alias("file_id"), F.lit("a").alias("mn"), F.lit("b").alias("mx"))
    with pytest.raises(runs.StoreError, match="more than 20"):
        runs.overlaps(files, files, True)
