"""Operator 5: secret scan, DataFrame functions only.

Base kinds are regular expressions. The method adds to them: candidate strings of one character
class (hexadecimal, base64), a window of WINDOW characters sliding over each, and the window's
Shannon entropy, updated from the counts of the one character that enters and the one that leaves.
A candidate with a window of high entropy gives a span from its first such window to its last,
unless the allow-list knows it or a base span holds it.

Spans are in code points, end exclusive. Defined results: null text is the empty text; empty text,
or text without a find, gives zero counts and empty strings; every row gives one row, repeated rows
too; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

KEYS = "(?:password|passwd|secret|token|api_?key)"
ASSIGN = rf"""(?i){KEYS}["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = rf"""(?i){KEYS}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: True of every text that has a match with a value of 12 characters, so the rest needn't be cut up.
ASSIGN_ANY = rf"""(?i){KEYS}["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{12}}"""
MIN_VALUE = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"

WINDOW = 20
#: Hits that are summed up in one step of located().
CHUNK = 64
RUN = "A-Za-z0-9+/_-"
#: Class, candidate strings, least entropy of a window in bits a character. Random hexadecimal
#: digits give about 3.4 in 20 characters and random base64 about 4.0; words stay below 3.5.
#: A candidate is a whole run of its class with a digit in it: words alone are no secrets.
CLASSES = (
    ("entropy_hex", r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{20,}(?![0-9A-Za-z])", 3.0),
    ("entropy_base64", rf"(?<![{RUN}])(?=[A-Za-z+/_-]*[0-9])[{RUN}]{{20,}}={{0,2}}", 3.7),
)
#: Candidates that are no secrets: without a letter, paths and slugs of words and numbers, UUIDs,
#: one character over and over, counting sequences, placeholders.
ALLOWED = (
    r"^[^A-Za-z]*$", r"^(?:[A-Za-z]*|[0-9]*)(?:[/_+-](?:[A-Za-z]*|[0-9]*))+=*$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^(.)\1*$",
    r"(?i)0123456789|abcdefgh|example|placeholder|your[_-]|changeme|dummy|redacted",
)


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


SPANS = "array<struct<start:int,end:int,hit:string>>"


def _empty(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def _chunks(items: Column, begin: Column, step) -> Column:
    """items in chunks of CHUNK, each folded by step. What depends on all items before is carried from chunk
    to chunk by the caller, so that no array grows item by item."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(items) - 1), F.lit(CHUNK))
    return F.transform(at, lambda k: F.aggregate(F.slice(items, k + 1, CHUNK), begin, step))


def _before(chunks: Column, first: Column, value) -> Column:
    """For each chunk, value(all before it, it) of the chunks before it."""
    upto = lambda acc, x: F.struct(value(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(chunks, F.struct(first.alias("at"), _empty("array<int>").alias("out")), upto, lambda acc: acc["out"])


def located(text: Column, pattern: str, found: Column) -> Column:
    """Array of (start, end, hit) of pattern in text, in order. found: where false, nothing is cut up. Starts
    are running sums."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("spans"))

    def summed(chunks: Column) -> Column:
        moved = lambda c, at: F.transform(c["spans"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["hit"].alias("hit")))
        return F.flatten(F.zip_with(chunks, _before(chunks, F.lit(0), lambda at, x: at + x["at"]), moved))

    pairs = _let(hits, lambda h: F.arrays_zip(F.slice(pieces, 1, F.size(h)).alias("piece"), h.alias("hit")))
    begin = F.struct(F.lit(0).alias("at"), _empty().alias("spans"))
    return F.when(found, _let(pairs, lambda x: _let(_chunks(x, begin, step), summed))).otherwise(_empty())


def uncovered(spans: Column, by: Column) -> Column:
    """Those of spans that none of `by` (start, end) holds: all in order of start, with the greatest end of
    `by` so far."""
    own = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("own"), x["end"].alias("end"), x["hit"].alias("hit")))
    other = F.transform(by, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("own"), x["end"].alias("end"), F.lit("").alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        far = F.when(x["own"] == 0, F.greatest(acc["far"], x["end"])).otherwise(acc["far"])
        seen = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), acc["far"].alias("far")))
        return F.struct(far.alias("far"), F.when(x["own"] == 1, F.concat(acc["spans"], seen)).otherwise(acc["spans"]).alias("spans"))

    def kept(chunks: Column) -> Column:
        free = lambda c, far: F.filter(c["spans"], lambda x: x["end"] > F.greatest(far, x["far"]))
        return F.flatten(F.zip_with(chunks, _before(chunks, F.lit(-1), lambda at, x: F.greatest(at, x["far"])), free))

    begin = F.struct(F.lit(-1).alias("far"), _empty("array<struct<start:int,end:int,hit:string,far:int>>").alias("spans"))
    out = _let(F.array_sort(F.concat(own, other)), lambda x: _let(_chunks(x, begin, step), kept))
    return F.when(F.size(spans) > 0, F.transform(out, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))).otherwise(_empty())


def high_windows(text: Column, least: float) -> Column:
    """(first, last): starts of the first and last window of text with at least that entropy, else
    nulls. Sums c * log2(c) over the counts of the window's characters change by two counts a step."""
    plog = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    chars = F.split(text, "")

    def changed(acc: Column, char: Column, by: int) -> Column:
        """acc (total, counts) with one more or one less of char."""
        return _let(
            F.struct(acc.alias("acc"), F.coalesce(acc["counts"][char], F.lit(0)).alias("n")),
            lambda x: F.struct(
                (x["acc"]["total"] + plog(x["n"] + by) - plog(x["n"])).alias("total"),
                F.map_concat(F.map_filter(x["acc"]["counts"], lambda k, _: k != char), F.when(x["n"] + by > 0, F.create_map(char, x["n"] + by)).otherwise(F.create_map().cast("map<string,int>"))).alias("counts"),
            ),
        )

    def step(acc: Column, i: Column) -> Column:
        entered = changed(acc["window"], F.element_at(chars, i), 1)
        window = _let(entered, lambda w: F.when(i > WINDOW, changed(w, F.element_at(chars, F.greatest(F.lit(1), i - WINDOW)), -1)).otherwise(w))

        def seen(w: Column) -> Column:
            high = (i >= WINDOW) & (F.lit(math.log2(WINDOW)) - w["total"] / WINDOW >= least)
            start = i - WINDOW
            return F.struct(w.alias("window"), F.when(high, F.coalesce(acc["first"], start)).otherwise(acc["first"]).alias("first"), F.when(high, start).otherwise(acc["last"]).alias("last"))

        return _let(window, seen)

    none = F.lit(None).cast("int")
    begin = F.struct(F.struct(F.lit(0.0).alias("total"), F.create_map().cast("map<string,int>").alias("counts")).alias("window"), none.alias("first"), none.alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _windows(least: float):
    return lambda x: F.struct(x["start"].alias("at"), high_windows(x["hit"], least).alias("w"))


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, arrays of spans by kind, base and all spans as text."""
    text = F.col("text")
    df = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    assign = F.filter(located(text, ASSIGN, text.rlike(ASSIGN_ANY)), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN_VALUE, 1)) >= MIN_VALUE)
    df = df.withColumns({"assign": _spans(assign, "assign", 0), "access": _spans(located(text, ACCESS, text.contains("AKIA")), "access", 1), "hex": _spans(located(text, HEX, text.rlike("[0-9a-f]{16}")), "hex", 2)})
    df = df.withColumn("base", F.concat("assign", "access", "hex")).withColumn("seen", F.col("base"))
    for rank, (kind, pattern, least) in enumerate(CLASSES, 3):
        fresh = F.filter(_let(located(text, pattern, text.rlike(pattern)), lambda x: uncovered(x, F.col("seen"))), lambda x: ~reduce(Column.__or__, [x["hit"].rlike(p) for p in ALLOWED]))
        # a second parameter, even one with a default, would get the element's index
        marked = F.transform(fresh, _windows(least))
        marked = F.transform(F.filter(marked, lambda x: x["w"]["first"].isNotNull()), lambda x: F.struct((x["at"] + x["w"]["first"]).alias("start"), (x["at"] + x["w"]["last"] + WINDOW).alias("end")))
        df = df.withColumn(kind, _spans(marked, kind, rank)).withColumn("seen", F.concat("seen", kind))
    df = df.drop("text")
    return df.withColumns({"base_spans": _joined(F.col("base")), "spans": _joined(F.col("seen"))})


def scan_query(docs: DataFrame) -> DataFrame:
    out = secret_scan(docs)
    count = lambda c: F.size(c).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
