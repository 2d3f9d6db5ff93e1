"""Records and blocks as bytes: a unit is a 16-bit little-endian length and that many bytes, a record a unit
each for key and value (and whatever else is given), a block a 16-bit count and its records.

Encoding is by SQL functions. Decoding is a walk, since each length says where the next one is; it runs
over Arrow batches, a block at a time, and stops at a length that overruns the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_UNIT = (1 << 16) - 1
#: Bytes of blocks that a task decodes at a time.
SLICE_BYTES = 1 << 20


def _u16(n: Column) -> Column:
    """Hexadecimal digits of a 16-bit number, low byte first."""
    digits = F.lpad(F.hex(n.cast("long")), 4, "0")
    return F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2))


def record(*units: Column) -> Column:
    """Hexadecimal digits of a record; null if a unit is null or longer than MAX_UNIT bytes."""
    parts = [F.when(F.octet_length(x) <= MAX_UNIT, F.concat(_u16(F.octet_length(x)), F.hex(x.cast("binary")))) for x in units]
    return F.concat(*parts)


def block(records: Column) -> Column:
    """Bytes of a block of an array of records."""
    return F.unhex(F.concat(_u16(F.size(records)), F.array_join(records, "")))


def read_units(buffer: bytes, at: int, units: int) -> tuple[list[bytes], int] | None:
    """The units of one record from `at` on and where it ends; None if it overruns the buffer."""
    out = []
    for _ in range(units):
        if at + 2 > len(buffer):
            return None
        size = int.from_bytes(buffer[at : at + 2], "little")
        at += 2
        if at + size > len(buffer):
            return None
        out.append(buffer[at : at + size])
        at += size
    return out, at


def read_block(buffer: bytes, units: int = 2) -> tuple[list[list[bytes]], int]:
    """The records of a block, as many as are whole, and the bytes read."""
    if len(buffer) < 2:
        return [], 0
    out, at = [], 2
    for _ in range(int.from_bytes(buffer[:2], "little")):
        got = read_units(buffer, at, units)
        if got is None:
            break
        out.append(got[0])
        at = got[1]
    return out, at


def sliced(rows: pa.RecordBatch, payload: str) -> Iterator[pa.RecordBatch]:
    """rows in slices of about SLICE_BYTES of payload, one row at least: records as Python's objects take many times
    their bytes, so only a slice's are held at once."""
    sizes = np.array([x or 0 for x in pc.binary_length(rows.column(payload)).to_pylist()], np.int64)
    slots = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), rows.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        yield rows.slice(lo, hi - lo)


def decoded(blocks: DataFrame, payload: str, names: list[str]) -> DataFrame:
    """A row for each record of each block: the block's other columns, `pos` in the block, and the record's
    units as strings by name."""
    others = [f for f in blocks.schema.fields if f.name != payload]
    schema = T.StructType([*others, T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, payload):
                of, pos, units = [], [], [[] for _ in names]
                for k, x in enumerate(b.column(payload)):
                    records, _ = read_block(x.as_py() or b"", len(names))
                    of += [k] * len(records)
                    pos += range(len(records))
                    for r in records:
                        for o, u in zip(units, r):
                            o.append(u.decode())
                held = b.select([f.name for f in others]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(pos, pa.int32()), *(pa.array(o, pa.string()) for o in units)], names=[*(f.name for f in others), "pos", *names])

    return blocks.select(*(f.name for f in others), payload).mapInArrow(run, schema)
