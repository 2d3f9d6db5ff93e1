"""Operator 9: exact deduplication by two-pass Bloom filtering (DataFrame functions only).

Pass 1 sets a bit for every text hash, BITS_PER_ROW bits a row, and marks the bits that two or more
rows set. Pass 2 probes them: a row whose bit is marked may be repeated and is shuffled to its group,
any other row is unique and passes straight through.

What pass 1 exchanges is the number of a bit and a count, once a task that sets it: sixteen bytes a row
before compression, no texts and no hashes. Bitmaps of one size merged by OR and AND would be more: to tell
which of 16 N bits a task of n rows has set takes at least n * log2(16 N / n) bits, and a bitmap of all
bits for each task is larger still from 1 / 64 of them set. One hash a row instead of two halves the
exchange; of the unique rows about 6 in 100 then meet another's bit and are shuffled too.

The marked bits are broadcast as a bitmap while all bits are at most MAX_BITS (32 MB). Beyond that,
fingerprints meet the words of the bitmap in a join by the word, one exchange of them whatever the size;
bits that more than 1 / HOT_SHARE of the rows set are left out of it, for those rows are marked by the
short list of such bits. Only fingerprints (row id, SHA-256) are ever shuffled or stored, never texts.

Defined results: null text is the empty text; equal means identical after lower-casing A-Z only;
texts of any length are hashed whole; in a group the row of the largest doc_id stays (null ids are
smallest), and of repeated rows with that same id exactly one stays; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, stored, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_ROW, MAX_BITS, WORD = 16, 1 << 28, 1 << 15
#: So many ids at most are broadcast to filter a corpus; beyond that the join is shuffled.
MAX_BROADCAST_IDS = 1_000_000


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does that, faster, where a text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, sha): row numbers rows, also those with the same id."""
    return docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalised(text_of(docs, text_col)).cast("binary"), 256)).alias("sha"))


def _is_set(bitmap: Column, at: Column) -> Column:
    bit = at % WORD
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(bitmap.isNull(), False).otherwise(F.getbit(byte, (bit % 8).cast("int")) == 1)


def marked(rows: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """rows and `maybe`: whether another of the n rows may have the same sha."""
    size = max(1, -(-BITS_PER_ROW * n // WORD)) * WORD
    rows = rows.withColumn("at", F.pmod(F.xxhash64("sha"), F.lit(size)))
    hit = rows.groupBy("at").count().where("count > 1")
    if size > max_bits:
        hit = stored(hit, "dedup-bits")
    twice = hit.groupBy(F.floor(F.col("at") / WORD).alias("word")).agg(F.bitmap_construct_agg(F.col("at") % WORD).alias("map"))
    tagged = lambda x: x.select("doc_id", "row", "sha", _is_set(F.col("map"), F.col("at")).alias("maybe"))
    rows = rows.withColumn("of", F.floor(F.col("at") / WORD))
    if size <= max_bits:
        return tagged(rows.join(F.broadcast(twice), F.col("of") == F.col("word"), "left"))
    hot = hit.where(F.col("count") > max(1, n // HOT_SHARE)).select(F.col("at").alias("hot"))  # fewer than HOT_SHARE rows
    rows = rows.join(F.broadcast(hot), F.col("at") == F.col("hot"), "left")
    rest = rows.where("hot IS NULL").join(twice, F.col("of") == F.col("word"), "left")
    return tagged(rest).union(rows.where("hot IS NOT NULL").select("doc_id", "row", "sha", F.lit(True).alias("maybe")))


def resolve(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, row, sha, keep_id, group_size, kept) for a stored table of fingerprints."""
    n = rows.count()
    tagged = marked(rows, n, max_bits)
    tagged = stored(tagged, "dedup-marked")
    alone = tagged.where("NOT maybe").select("doc_id", "row", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = tagged.where("maybe").drop("maybe")
    groups = stored(again.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")), "dedup-groups")
    hot = groups["group_size"] > max(1, n // HOT_SHARE)
    few = F.broadcast(groups.where(hot))  # fewer than HOT_SHARE rows, see above
    by_sha = [again.join(few, "sha"), again.join(few.select("sha"), "sha", "left_anti").join(groups.where(~hot), "sha")]
    met = [x.select("doc_id", "row", "sha", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept")) for x in by_sha]
    return reduce(DataFrame.union, [alone, *met])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    found = resolve(stored(fingerprints(docs, id_col, text_col), "dedup-fingerprints"), max_bits)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in ids (a stored table with one column)."""
    ids = ids.select(F.col(ids.columns[0]).alias("__drop"))
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].eqNullSafe(ids["__drop"]), "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were."""
    found = stored(resolve(stored(fingerprints(docs, id_col, text_col), "dedup-fingerprints")).select("doc_id", "sha", "kept"), "dedup-found")
    dropped = found.where("NOT kept")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():  # ids are repeated: they alone don't tell rows apart
        sha, kept = F.unhex(F.sha2(normalised(text_of(docs, text_col)).cast("binary"), 256)), found.where("kept").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"))
        left = docs.withColumn("__key", sha)
        left = left.join(kept, left[id_col].eqNullSafe(kept["__id"]) & (left["__key"] == kept["__sha"]), "left_semi")
        return left.withColumn("__id", F.coalesce(left[id_col].cast("string"), F.lit("null"))).dropDuplicates(["__id", "__key"]).select(*docs.columns)
    return without_ids(docs, dropped.select("doc_id"), id_col)


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
