"""Look-ups of keys in runs against the filters looked at pair by pair, and what they cost."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import pruning, runs


def runs_of(spark):
    rng = random.Random(6)
    held = sorted({(g % 3, g, f"k{rng.randrange(500):03d}") for g in range(25) for _ in range(rng.choice([1, 5, 120]))})
    asked = [f"k{i:03d}" for i in range(0, 700, 3)] + ["", "a", "kö"]
    return held, spark.createDataFrame(held, "shard long, run_id long, k string"), asked, spark.createDataFrame([(k,) for k in asked], "k string")


@pytest.mark.parametrize("cell", [(4, 30, 50), (4096, 50_000, 200_000)])
@pytest.mark.parametrize("blocked", [False, True])
def test_probed(spark, blocked, cell, monkeypatch):
    for name, n in zip(("RUNS_A_CELL", "KEYS_A_CELL", "ROWS_A_BATCH"), cell):
        monkeypatch.setattr(pruning, name, n)
    by = ["shard", "run_id"]
    held, files, asked, keys = runs_of(spark)
    found = pruning.probed(files, keys, by, blocked)
    got = sorted(map(tuple, found.collect()))
    ends = {}
    for s, r, k in held:
        lo, hi = ends.get((s, r), (k, k))
        ends[s, r] = min(lo, k), max(hi, k)
    pairs = [(s, r, k) for (s, r), (lo, hi) in ends.items() for k in asked if k and lo <= k <= hi]
    hit = spark.createDataFrame(pairs, "shard long, run_id long, k string")
    old = pruning.blocked_may_contain(pruning.blocked_blooms(files, by), hit, by) if blocked else pruning.may_contain(pruning.run_blooms(files, by), hit, by)
    maybe, own = {tuple(r)[:3]: r["maybe"] for r in old.collect()}, set(held)
    assert got == sorted((*p, maybe[p], p in own) for p in pairs) and {g[3:] for g in got} >= {(True, True), (False, False)}
    assert found.rdd.getNumPartitions() == -(-len(ends) // cell[0]) * (1 + len([k for k in asked if k]) // cell[1])  # keys and runs meet in cells


def test_touched_makes_no_pairs(spark):
    held, files, asked, keys = runs_of(spark)
    meta = files.withColumns({"seq": F.lit(1), "z": F.lit(1)}).transform(lambda f: runs.file_meta(f, ["shard", "run_id"]))
    ranges = [(r["mn"], r["mx"]) for r in meta.collect()]
    found = runs.touched(meta, keys)
    want = {k: sum(a <= k <= b for a, b in ranges) for k in asked}
    assert {r["k"]: r["touched"] for r in found.collect()} == {k: n for k, n in want.items() if n}
    text = found._jdf.queryExecution().toString()
    assert "Join" not in text and "Generate" not in text
