"""Operator 2: near-duplicates by BagMinHash, banding and verified multiset overlap.

Two texts are linked if the multisets of their runs of five words have a weighted Jaccard similarity
of THRESHOLD or more; classes are the connected components of the links. Steps:

1. Texts with the same words are one node. Each node gets a BagMinHash signature and BANDS bucket keys.
2. In each bucket the node that comes first in a fixed random order is its pivot. A node is verified
   against the pivot it agrees with most; verified ones hang below it, which gives trees. So a bucket
   of any size costs one comparison a node.
3. What could still be lost is a link between two trees. Buckets with nodes of several trees are cut
   into cells of at most 2 x CELL nodes: every node against every node that isn't in the bucket's
   largest tree. First each tree is verified against the trees whose signatures agree with its most,
   and linked trees are joined; that joins what a large group of copies is in.
4. Then all pairs of nodes of different trees whose signatures agree leave the cells, each from the
   first bucket it shares, and are verified, those that agree most first. Components come from
   repeated contraction.

A pair at similarity s shares no bucket with probability (1 - s ** ROWS) ** BANDS, 7e-6 at 0.8 and
2e-9 at 0.85; the signature filter at LEAST drops a pair at 0.8 with about 3e-5. Verification is
of the whole multisets (of 64-bit hashes of the shingles). No bucket, group or candidate list is capped.

Keys that many rows may share (a word key, a bucket, a class, the node that many pairs have) are split:
hot ones meet the other side by broadcast, of which there are fewer than HOT_SHARE, or in SALTS parts.

Defined results: null or empty text, or text without a word, is the empty multiset, and all of those
are one class; texts of any length are compared whole; ties (equal signatures, equal sizes) are broken
by hashes of row numbers and don't change the classes; repeated rows are rows of one class; class_id is
the smallest doc_id of the class (null if it has none); an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import bands, multiset, shingles, signatures, similarity
from .common import collect, join_split, release, scratch, ship, stored, text_of
from .exact_dedup import MAX_BROADCAST_IDS, without_ids

THRESHOLD, LEAST = 0.8, 0.755
BANDS, ROWS, REGISTERS, GLANCE = 30, 5, 1280, 128
CELL, SHARE = 1024, 256
#: Parts in which pairs with a hot node learn in how many cells they are verified.
SALTS = 64
#: Pairs that each tree has verified, those that agree most, before all pairs are; again with more of them
#: for the trees that are left. Two large trees with thousands of links between them are joined by one.
FIRST = (1, 8)
#: Of all pairs, those whose signatures agree so well are verified first; trees that this joins need no more.
STEPS = (1.0, 0.785, LEAST)
CHUNK_DOCS, CHUNK_BYTES = 400, 3 << 19
#: So many edges, 2 MB, are left to one task; contracting them further takes a dozen more queries.
FEW_EDGES = 1 << 17


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    held, size, start = [], 0, 0
    for k, x in enumerate(batch.column("text")):
        held.append(x.as_py())
        size += len(held[-1])
        if len(held) >= CHUNK_DOCS or size >= CHUNK_BYTES:
            yield start, k + 1, held
            held, size, start = [], 0, k + 1
    if held:
        yield start, start + len(held), held


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, content, key, n, buckets): content tells rows of one doc_id apart, key is of the
    words, n the number of shingles."""
    names = ["doc_id", "row", "content", "key", "n", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, texts in _chunks(b):
                own = b.slice(start, stop - start)
                hashes, counts, keys = shingles(texts)
                flat = pa.array(bands(signatures(hashes, counts, BANDS * ROWS), BANDS, ROWS).reshape(-1), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("row"), own.column("content"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), lists], names=names)
        release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text_of(docs)).alias("content"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, content long, key binary, n long, buckets array<long>")


def looked_up(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, text, sig) of the nodes that share a bucket; sig has 8 bits for each of REGISTERS, far more
    than the buckets need, so that few pairs below the threshold are verified in vain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, texts in _chunks(b):
                hashes, counts, _ = shingles(texts)
                sig = signatures(hashes, counts, REGISTERS).astype(np.uint8)
                own = b.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("text"), pa.array([x.tobytes() for x in sig], pa.binary())], names=["row", "text", "sig"])
        release()

    need = nodes.select("row", F.col("doc_id").alias("__id"), F.col("content").alias("__content"))
    few = need.count() <= MAX_BROADCAST_IDS
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("content", F.xxhash64("text"))
    found = own.join(F.broadcast(need) if few else need, own["doc_id"].eqNullSafe(need["__id"]) & (own["content"] == need["__content"])).select("row", "text")
    return found.mapInArrow(run, "row long, text string, sig binary")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that signatures of 8 bits a register estimate, less their chance agreement."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        if len(x):
            a, b = (np.frombuffer(b"".join(x[c]), np.uint8).reshape(len(x), -1) for c in ("sig_a", "sig_b"))
            yield pd.DataFrame({"a": x["a"], "b": x["b"], "est": agreement(a, b)})


def _sized(n: Column, m: Column) -> Column:
    """Whether the sizes allow the similarity: it is at most the smaller size over the larger."""
    return (n >= THRESHOLD * m) & (m >= THRESHOLD * n)




def _verify(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """left: texts of nodes a that are paired with node b of right."""
    out = []
    if len(left) and len(right):
        pivot = multiset(right["text"].iloc[0])
        out = [a for a, text in zip(left["a"], left["text"]) if similarity(multiset(text), pivot) >= THRESHOLD]
    return pd.DataFrame({"a": pd.Series(out, dtype="int64"), "b": pd.Series([key[0]] * len(out), dtype="int64")})


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts are linked. Each a's text meets b's, which is dealt out to
    several tasks where many pairs have it."""
    texts = texts.select("row", "text")
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("shares")).where("shares > 1")
    shares = shares.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("a", F.lit(SALTS)), F.lit(SALTS))).join(shares, ["b", "part"], "left")
    salted = salted.select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1))).alias("salt"))
    left = salted.join(texts.withColumnRenamed("row", "a"), "a").toDF("a", "b", "salt", "text")
    cells = salted.select("b", "salt").distinct()
    right = cells.join(texts.withColumnRenamed("row", "b"), "b").toDF("b", "salt", "text")
    return left.groupBy("b", "salt").cogroup(right.groupBy("b", "salt")).applyInPandas(_verify, "a long, b long")


def rooted(links: DataFrame) -> DataFrame:
    """(row, root) of the trees that links (a, b) make, each a having one b that comes before it; stored."""
    with scratch(links.sparkSession) as keep:
        at = stored(links.select(F.col("a").alias("row"), F.col("b").alias("root")), "near-trees")
        while True:
            up = at.select(F.col("row").alias("root"), F.col("root").alias("next"))
            held = stored(at.join(up, "root", "left").select("row", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "near-trees")
            at = held.select("row", "root")
            if held.where("moved").isEmpty():
                keep(held)
                return at


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of the edges (a, b) and the smallest that it is connected to."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for edges in batches:
        for a, b in zip(edges["a"].tolist(), edges["b"].tolist()):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": pd.Series(list(above), dtype="int64"), "to": pd.Series([top(x) for x in list(above)], dtype="int64")})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of an undirected graph (a, b): every node hooks to its first neighbour in a random
    order, hooked nodes are contracted, until at most FEW_EDGES are left, which one task joins. Stored."""
    with scratch(edges.sparkSession) as keep:
        edges = stored(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
        labels, turn = None, 0
        while left := edges.count():
            if left <= FEW_EDGES:
                hook = stored(edges.coalesce(1).mapInPandas(_joined, "node long, to long"), "cc-hook")
            else:
                both = edges.union(edges.select("b", "a"))
                to = F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("to")
                hook = both.groupBy(F.col("a").alias("node")).agg(to)
                hook = stored(hook.select("node", F.when(F.xxhash64("to", F.lit(turn)) < F.xxhash64("node", F.lit(turn)), F.col("to")).otherwise(F.col("node")).alias("to")), "cc-hook")
            if labels is None:
                labels = hook.withColumnRenamed("to", "label")
            else:  # read when all turns are done: a turn has fewer nodes than the one before
                labels = labels.join(hook.withColumnsRenamed({"node": "label", "to": "next"}), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            if left <= FEW_EDGES:
                break
            for c in "ab":
                edges = edges.join(hook.withColumnsRenamed({"node": c, "to": f"{c}2"}), c)
            edges = stored(edges.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "cc-edges")
            turn += 1
        if labels is None:
            labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        return keep(stored(labels, "cc-labels"))


def _cells(least: float, most: float, top: int):
    """Rows sorted by cell: pairs of a cell's sides (0: all nodes, 1: the others) of different trees that
    may be linked. top 0: each of them, in the first bucket that its nodes share; else for each tree of
    side 1 so many pairs, those that agree most."""

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(rows):
            return
        key = rows[["bucket", "i", "j"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        side, row, tree, n = (rows[c].to_numpy() for c in ("side", "row", "tree", "n"))
        main = rows["main"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
        buckets = np.stack(rows["buckets"].to_numpy())
        got: list[np.ndarray] = []
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(rows))):
            left, right = (np.arange(lo, hi)[side[lo:hi] == s] for s in (0, 1))
            for y in right:
                x = left[(tree[left] != tree[y]) & (n[left] >= THRESHOLD * n[y]) & (n[y] >= THRESHOLD * n[left])]
                # GLANCE registers tell most pairs apart: those 5 standard deviations below are out
                x = x[agreement(sig[x, :GLANCE], sig[y, :GLANCE]) >= LEAST - 0.2]
                est = agreement(sig[x], sig[y])
                due = (est >= least) & (est < most)
                x, est = x[due], est[due]
                if not len(x):
                    continue
                if not top:
                    shared = buckets[x] == buckets[y]
                    first = buckets[y][shared.argmax(axis=1)] == key[lo, 0]
                    # both nodes outside the largest tree: the pair comes in both orders, one is enough
                    first &= (tree[x] == main[y]) | (row[x] < row[y])
                    x, est = x[first], est[first]
                else:
                    best = np.argsort(-est, kind="stable")[:top]
                    x, est = x[best], est[best]
                got += [(row[k], row[y], tree[k], tree[y], e) for k, e in zip(x, est)]
        if got:
            out = pd.DataFrame(got, columns=["a", "b", "tree_a", "tree_b", "est"])
            yield out.sort_values("est", ascending=False).groupby("tree_b").head(top) if top else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch.reset_index(drop=True) if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            end = rows[["bucket", "i", "j"]].iloc[-1]
            open_ = ((rows["bucket"] == end["bucket"]) & (rows["i"] == end["i"]) & (rows["j"] == end["j"])).to_numpy()
            yield from pairs(rows[~open_])
            rest = rows[open_]
        if rest is not None:
            yield from pairs(rest)

    return run


def between_trees(members: DataFrame, nodes: DataFrame, texts: DataFrame, trees: DataFrame, least: float, most: float, top: int) -> DataFrame:
    """(a, b, tree_a, tree_b): pairs of nodes in one bucket but different trees that may be linked; all
    of them, or for each tree the `top` that agree most. Made of stored tables of the scope around."""
    at = members.join(trees.withColumnRenamed("root", "tree"), "row", "left").select("bucket", "row", F.coalesce("tree", "row").alias("tree"))
    at = stored(at, "near-buckets")
    shares = at.groupBy("bucket", "tree").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("n", "tree")).alias("largest"), F.sum("n").alias("all"), F.count("*").alias("trees")).where("trees > 1")
    mixed = stored(mixed.select("bucket", F.col("largest.tree").alias("main"), F.ceil(F.col("all") / CELL).alias("rows"), F.ceil((F.col("all") - F.col("largest.n")) / CELL).alias("cols"), "all"), "near-mixed")
    here = join_split(at, mixed, "bucket", "all").join(nodes.select("row", "n", "buckets"), "row").join(texts.select("row", "sig"), "row")
    here = here.withColumns({"i": F.pmod(F.xxhash64("row"), F.col("rows")), "j": F.pmod(F.xxhash64("row", F.lit(1)), F.greatest(F.col("cols"), F.lit(1)))})
    keep = ["bucket", "i", "j", "side", "row", "tree", "main", "n", "sig", "buckets"]
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = here.drop("j").withColumn("j", upto("cols")).withColumn("side", F.lit(0)).select(*keep)
    right = here.where("tree <> main").drop("i").withColumn("i", upto("rows")).withColumn("side", F.lit(1)).select(*keep)
    cells = left.union(right).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cells.mapInPandas(_cells(least, most, top), "a long, b long, tree_a long, tree_b long, est double")
    if not top:
        return found.repartition("b")  # few pairs, so few files
    order = Window.partitionBy("tree_b").orderBy(F.col("est").desc(), "a", "b")  # a pair may come from several buckets
    best = found.dropDuplicates(["a", "b"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return best.drop("place")


def merged(trees: DataFrame, links: DataFrame) -> DataFrame:
    """(row, root) after joining the trees (tree_a, tree_b) of the links; stored."""
    with scratch(trees.sparkSession) as keep:
        joined = components(links.select(F.col("tree_a").alias("a"), F.col("tree_b").alias("b")))
        below = trees.join(joined.withColumnRenamed("node", "root"), "root", "left").select("row", F.coalesce("label", "root").alias("root"))
        roots = joined.select(F.col("node").alias("row"), F.col("label").alias("root")).join(trees.select("row"), "row", "left_anti")
        return keep(stored(below.union(roots), "near-trees"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, row, content, class_id, class_size, first (whether it is the row
    of its class that stays: the one of the smallest doc_id)."""
    spark = docs.sparkSession
    ship(spark)
    with scratch(spark) as keep:
        rows = stored(signed(docs), "near-signed")
        texts = stored(rows.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("size")), "near-keys")
        nodes = rows.join(texts.select(F.col("node").alias("row")), "row", "left_semi").where("n > 0")
        buckets = nodes.select("row", F.explode("buckets").alias("bucket"))
        # longs all: aggregates of structs would be sorted instead of hashed
        shared = buckets.groupBy("bucket").agg(F.count("*").alias("rows"), F.min_by("row", F.xxhash64("row")).alias("pivot")).where("rows > 1")
        shared = stored(shared, "near-shared")
        members = stored(join_split(buckets, shared, "bucket", "rows").select("bucket", "row", "pivot"), "near-members")
        inside = stored(nodes.join(members.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "content", "n", "buckets"), "near-nodes")
        found = looked_up(inside, docs)
        again = rows.groupBy("doc_id", "content").count().where("count > 1")  # equal rows are looked up once each
        texts_of = stored(found if again.isEmpty() else found.dropDuplicates(["row"]), "near-texts")
        # the pivot that a node shares most buckets with is nearly always the one it is closest to
        stars = members.where("row <> pivot").groupBy("row", "pivot").count().groupBy("row").agg(F.max_by("pivot", F.shiftleft("count", 50) + F.shiftrightunsigned(F.xxhash64("pivot"), 14)).alias("b")).withColumnRenamed("row", "a")
        side = lambda c: inside.join(texts_of.select("row", "sig"), "row").select(F.col("row").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
        stars = stars.join(side("a"), "a").join(side("b"), "b").where(_sized(F.col("n_a"), F.col("n_b"))).select("a", "b", "sig_a", "sig_b")
        stars = stored(stars.mapInPandas(_estimates, "a long, b long, est double").where(F.col("est") >= LEAST).select("a", "b"), "near-stars")
        trees = rooted(verified(stars, texts_of))
        collect(spark)
        turns = [*((LEAST, 2.0, top) for top in FIRST), *((least, 2.0 if most == 1.0 else most, 0) for most, least in zip(STEPS, STEPS[1:]))]
        for least, most, top in turns:
            with scratch(spark) as up:
                cross = stored(between_trees(members, inside, texts_of, trees, least, most, top), "near-cross")
                links = stored(verified(cross.select("a", "b"), texts_of).join(cross, ["a", "b"]), "near-links")
                if not links.isEmpty():
                    trees = up(merged(trees, links))
            collect(spark)
        label = trees.select(F.col("row").alias("node"), F.col("root").alias("label"))
        classes = stored(texts.join(label, "node", "left").select("key", F.coalesce("label", "node").alias("label"), "size"), "near-classes")
        of = stored(join_split(rows.select("key", "row", "doc_id", "content"), classes, "key", "size").select("row", "doc_id", "content", "label"), "near-rows")
        heads = of.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"), F.count("*").alias("class_size"))
        heads = stored(heads, "near-heads")
        keep(of), keep(heads)
    return join_split(of, heads, "label", "class_size").select("doc_id", "row", "content", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("head.row") == F.col("row")).alias("first"))


def near_query(docs: DataFrame) -> DataFrame:
    return near_classes(docs).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, all columns as they were."""
    found = stored(near_classes(docs), "near-found")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return without_ids(docs, found.where("NOT first").select("doc_id"))
    kept = found.where("first").select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"))
    own = docs.withColumn("__own", F.xxhash64(text_of(docs)))
    own = own.join(kept, own["doc_id"].eqNullSafe(kept["__id"]) & (own["__own"] == kept["__content"]), "left_semi")
    return own.withColumn("__id", F.coalesce(own["doc_id"].cast("string"), F.lit("null"))).dropDuplicates(["__id", "__own"]).select(*docs.columns)
